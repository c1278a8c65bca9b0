"""The feature matrix: one row per run with keys, commit, author, history and dependency columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.keys import DAY_S
from runloom.operators import commits as C
from runloom.operators import dependency, history
from runloom.operators.evaluate import completed
from runloom.session import stored

KEYS = ("repo", "commit_sha", "test_id", "label", "timestamp", "job_sequence")
MISSING = {"commit_meta_missing": 1, "commit_diff_missing": 1, "author_failure_rate_90d": -1.0, "author_feature_fallback": 1, "feature_source": "job_sequence", "dependency_parse_failed": 1}  # else 0
COLUMNS = (*KEYS, *C.COMMIT_COLUMNS, *C.AUTHOR_COLUMNS, *history.COLUMNS, *dependency.COLUMNS)


def feature_matrix(runs: DataFrame, commits: DataFrame, files: DataFrame, numstat: DataFrame | None = None, imports: DataFrame | None = None, poms: DataFrame | None = None, sources: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The 38 columns (and ``carry``) for each run. runs: sequenced_runs, stored, as they are read several times; commits: commit_rows; files: changed_files.

    Commit and author columns are computed per commit, dependency columns per commit and test, then joined. A run
    without a commit has the default row: a null key meets nothing.
    """
    keys = runs.select("repo", "commit_sha").where(F.col("commit_sha").isNotNull()).distinct()
    per_commit = C.commit_features(keys, commits, files, numstat).join(C.author_features(keys, C.author_commits(runs, commits)), ["repo", "commit_sha"])
    per_test = dependency.dependency_features(runs.where(F.col("commit_sha").isNotNull()), files, imports, poms, sources)
    past = history.test_history(runs, ("id", "repo", "commit_sha", "test_id", "failed", "timestamp", "job_sequence"), is_stored=True)
    known = per_test.join(per_commit, ["repo", "commit_sha"])  # they meet first: the rows of the history are shuffled once more, not twice
    out = past.join(known, ["repo", "commit_sha", "test_id"], "left").withColumn("label", F.col("failed"))
    fill = [F.coalesce(c, F.lit(MISSING.get(c, 0))).alias(c) for c in (*C.COMMIT_COLUMNS, *C.AUTHOR_COLUMNS, *dependency.COLUMNS)]
    return out.select(*carry, *KEYS, *fill, *history.COLUMNS).select(*carry, *COLUMNS)


def value_counts(runs: DataFrame, commits: DataFrame, files: DataFrame, numstat: DataFrame | None = None, imports: DataFrame | None = None, poms: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(feature, value, n, failed): how many runs, and failed ones, have each value of the numeric commit, author and dependency columns of
    ``feature_matrix``, without its rows: columns of a commit are counted once per commit, by the commit's runs. runs: stored."""
    tested = stored(C.tested_commits(runs), "tested")
    keys = tested.select("repo", "commit_sha")
    authors = C.author_features(keys, stored(C.with_authors(tested, commits), "authored"))
    rows = C.commit_features(keys, commits, files, numstat).join(authors, ["repo", "commit_sha"]).join(tested.select("repo", "commit_sha", "n", "fails"), ["repo", "commit_sha"])
    of_commits = [c for c in (*C.COMMIT_COLUMNS, *C.AUTHOR_COLUMNS) if c != "feature_source"]
    long = rows.select("n", "fails", F.posexplode(F.array(*[F.col(c).cast("double") for c in of_commits])).alias("f", "value"))
    counts = long.groupBy("f", "value").agg(F.sum("n").alias("n"), F.sum("fails").alias("failed"))
    counts = counts.select(F.get(F.array(*map(F.lit, of_commits)), F.col("f")).alias("feature"), "value", "n", "failed")
    counts = stored(counts.unionByName(dependency.dependency_counts(runs, files, imports, poms, sources)), "counts")
    total = runs.agg(F.count("*"), F.coalesce(F.sum("failed"), F.lit(0))).first()
    return completed(counts, tuple(total), {c: MISSING.get(c, 0) for c in (*of_commits, *dependency.COLUMNS)})


def in_order(matrix: DataFrame) -> DataFrame:
    """The rows in the order they are reported in: by time (a job's place where there is none), job, commit and test; nulls last. For the
    end of a plan only: a total order is a range shuffle of all rows."""
    time = F.coalesce("timestamp", F.col("job_sequence") * DAY_S)
    return matrix.orderBy(time.asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("job_sequence", "commit_sha", "test_id")])


def known_means(matrix: DataFrame, columns: tuple[str, ...] = history.COLUMNS, sentinels: tuple[float, ...] = (history.NEVER_DAYS, -1.0)) -> DataFrame:
    """(feature, known, mean) of each column without the values that stand for an unknown one, in one pass."""
    known = lambda c: F.when(~F.col(c).cast("double").isin(*sentinels), F.col(c).cast("double"))
    got = matrix.agg(*[F.struct(F.count(known(c)).alias("known"), F.avg(known(c)).alias("mean")).alias(c) for c in columns])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.known").alias("known"), F.col(f"{c}.mean").alias("mean")) for c in columns])).alias("x")).select("x.*")
