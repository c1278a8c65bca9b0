import datetime as dt
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}/shared")
        .config("spark.local.dir", shared)
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


RUNS = "id bigint, repo string, job_id string, commit_sha string, test_id string, test_index int, outcome string, duration_ms float, timestamp bigint, job_sequence bigint, run_count int, loaded_at timestamp_ntz"
COMMITS = "repo string, commit_sha string, author_email string, message string, parent_count int, authored_at timestamp_ntz, utc_offset_min int, committed_ts bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = 1_700_000_000


def at(seconds):
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def make_runs(spark):
    """Rows of test_runs from dicts with defaults."""

    def make(rows):
        base = {"repo": "a@b", "job_id": "1", "commit_sha": None, "test_id": "x.T", "test_index": 0, "outcome": "PASS", "duration_ms": 10.0, "timestamp": T0, "job_sequence": 1, "run_count": 1, "loaded_at": at(T0 + 10**6)}
        names = [c.split()[0] for c in RUNS.split(", ")]
        return spark.createDataFrame([tuple((base | {"id": k} | r)[n] for n in names) for k, r in enumerate(rows, 1)], RUNS)

    return make


@pytest.fixture(scope="session")
def make_commits(spark):
    def make(rows):
        base = {"repo": "a@b", "author_email": "x@y", "message": "", "parent_count": 1, "authored_at": at(T0), "utc_offset_min": 0, "committed_ts": T0, "loaded_at": at(T0), "deleted_at": None}
        names = [c.split()[0] for c in COMMITS.split(", ")]
        return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], COMMITS)

    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
