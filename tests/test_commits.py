import datetime as dt

import pytest

from runloom.operators import commits as C
from runloom.operators import ingest
from tests.conftest import T0, rows

S = [f"{k:040x}" for k in range(1, 9)]
FILES = "repo string, commit_sha string, file_path string, loaded_at timestamp_ntz"


def files(spark, paths, sha=S[0]):
    return ingest.changed_files(spark.createDataFrame([("a@b", sha, p, None) for p in paths], FILES))


def features(spark, make_commits, paths, commit, numstat=None):
    keys = spark.createDataFrame([("a@b", S[0])], "repo string, commit_sha string")
    commits = ingest.commit_rows(make_commits([commit] if commit else []))
    if numstat is not None:
        numstat = spark.createDataFrame([("a@b", S[0], *n) for n in numstat], "repo string, commit_sha string, parent_no int, added string, deleted string, path string")
    return C.commit_features(keys, commits, files(spark, paths), numstat).first()


def test_counts_and_calendar(spark, make_commits):
    r = features(spark, make_commits, ["src/main/A.java", "src/test/java/ATest.JAVA", "README.md", "a\\test\\B.java"], {"commit_sha": S[0], "authored_at": dt.datetime(2024, 1, 3, 10), "message": "Hotfix for runtime error"}, [(1, "3", "1", "a"), (1, "-", "-", "b"), (2, "9", "9", "a")])
    assert (r.files_changed_total, r.java_files_changed, r.source_files_changed, r.test_files_changed) == (4, 3, 1, 2)
    assert (r.lines_added, r.lines_deleted, r.churn_total, r.commit_diff_missing, r.commit_meta_missing) == (3, 1, 4, 0, 0)
    assert (r.commit_hour, r.commit_day_of_week, r.keyword_risk_score, r.is_merge_commit) == (10, 2, 2, 0)


def test_root_merge_and_missing(spark, make_commits):
    r = features(spark, make_commits, [], {"commit_sha": S[0], "parent_count": 0}, [])
    assert (r.lines_added, r.commit_diff_missing, r.commit_meta_missing) == (0, 0, 0)
    assert features(spark, make_commits, [], {"commit_sha": S[0], "parent_count": 2}).is_merge_commit == 1
    r = features(spark, make_commits, ["x.java"], None)
    assert (r.files_changed_total, r.commit_meta_missing, r.commit_diff_missing, r.commit_hour) == (1, 1, 1, 0)


def test_local_hour(spark, make_commits):
    r = features(spark, make_commits, [], {"commit_sha": S[0], "authored_at": dt.datetime(2024, 1, 3, 23), "utc_offset_min": 120})
    assert (r.commit_hour, r.commit_day_of_week) == (1, 3)


def test_whole_words_only(spark):
    texts = ["fix bug", "prefix_fix debug errors", "FIX: crash!", "a fix, a fix", None]
    got = spark.createDataFrame([(t,) for t in texts], "m string").select(C.keyword_score(__import__("pyspark").sql.functions.col("m"))).collect()
    assert [r[0] for r in got] == [2, 0, 2, 1, 0]


def test_diff_lines(spark):
    diff = "--- a\n+++ b\n+one\n+two\n-three\n same"
    r = spark.createDataFrame([(diff,)], "d string").select(*C.diff_lines(__import__("pyspark").sql.functions.col("d"))).first()
    assert tuple(r) == (2, 1)


@pytest.fixture(scope="module")
def authored(spark):
    def make(rows):
        return spark.createDataFrame([("r", s, "x@y", ts, f, seq, seq if f else None) for s, ts, f, seq in rows], "repo string, commit_sha string, author_email string, ts bigint, failed int, first_seq bigint, first_fail_seq bigint")

    return make


@pytest.mark.parametrize("hot", [C.HOT_COMMITS, 2])
def test_author_by_time(authored, hot):
    day = 86400
    df = authored([("a", T0 - 91 * day, 1, 1), ("b", T0 - 90 * day, 1, 2), ("c", T0 - 5, 0, 3), ("d", T0 - 4, 0, 4), ("e", T0, 1, 5), ("f", T0 + 9, 0, 6)])
    got = {r.commit_sha: r for r in C.author_by_time(df, hot).collect()}
    assert got["e"].author_commit_count_90d == 3 and got["e"].author_failure_rate_90d == pytest.approx(1 / 3)
    assert (got["b"].author_commit_count_90d, got["b"].author_failure_rate_90d) == (1, -1.0)
    assert (got["a"].author_commit_count_90d, got["a"].author_feature_fallback, got["a"].feature_source) == (0, 0, "timestamp")


@pytest.mark.parametrize("hot", [C.HOT_COMMITS, 2])
def test_author_by_sequence(authored, hot):
    got = {r.commit_sha: r for r in C.author_by_sequence(authored([("a", None, 1, 1), ("b", None, 0, 2), ("c", None, 0, 3), ("d", None, 0, 9)]), hot).collect()}
    assert got["d"].author_commit_count_90d == 3 and got["d"].author_failure_rate_90d == pytest.approx(1 / 3)
    assert got["b"].author_commit_count_90d == 1 and got["b"].feature_source == "job_sequence"


def test_author_default(spark, authored):
    keys = spark.createDataFrame([("r", "zz"), ("r", "a")], "repo string, commit_sha string")
    got = rows(C.author_features(keys, authored([("a", T0, 0, 1)])), "commit_sha", "author_commit_count_90d", "author_failure_rate_90d", "author_feature_fallback", "feature_source")
    assert got == [("a", 0, -1.0, 0, "timestamp"), ("zz", 0, -1.0, 1, "job_sequence")]


def test_latest_commit_row_and_first_run(make_commits, make_runs):
    got = ingest.commit_rows(make_commits([{"commit_sha": S[0].upper(), "message": "old"}, {"commit_sha": S[0], "message": "new", "loaded_at": dt.datetime(2030, 1, 1)}, {"commit_sha": "short"}])).collect()
    assert [(r.commit_sha, r.message) for r in got] == [(S[0], "new")]
    runs = ingest.sequenced_runs(make_runs([{"job_id": "9"}, {"job_id": "10", "timestamp": None}, {"job_id": "10.0", "outcome": "FAIL"}, {"job_id": "x"}]))
    assert rows(runs, "id", "job_sequence", "ets", "failed") == [(1, 1, T0, 0), (2, 2, 2 * 86400, 0)]
