"""Gates on the feature matrix and profiles of nulls, each in one or two aggregate passes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.past import strictly_before

MAY_BE_NULL = ("timestamp", "feature_source", "commit_sha", "test_id", "job_sequence")
NO_FEATURES = ("commit_sha", "test_id", "label", "timestamp", "feature_source", "job_sequence")
REQUIRED = ("repo", "label", "timestamp", "feature_source", "commit_sha", "test_id")
SOURCES = ("timestamp", "job_sequence")
MOST_NULLS = 0.05
LEAST_FEATURES = 20
LEAST_COVERAGE = 70.0  # per cent
LEAST_PROJECTS = 3
# Per cent of rows with sequence-based author features of known projects, and how far they may be off.
SOURCE_BASELINES = {
    "adamfisk@LittleProxy": (30.42, "relative", 0.01),
    "l0rdn1kk0n@wicket-bootstrap": (19.53, "relative", 0.01),
    "thinkaurelius@titan": (12.91, "relative", 0.01),
    "deeplearning4j@deeplearning4j": (5.70, "relative", 0.01),
    "neuland@jade4j": (0.10, "absolute", 0.5),
}


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, share) of every column, from one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = counts.select("_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("x"))
    return rows.select("x.column", "x.nulls", F.try_divide(F.col("x.nulls").cast("double"), F.col("_rows")).alias("share"))


def source_shares(df: DataFrame) -> DataFrame:
    """(repo, rows, by_sequence_pct): the share of rows whose author features come from the sequence."""
    share = 100 * F.avg((F.col("feature_source") == "job_sequence").cast("double"))
    return df.groupBy("repo").agg(F.count("*").alias("rows"), share.alias("by_sequence_pct"))


def repo_profile(df: DataFrame) -> DataFrame:
    """source_shares with the failures and the share of rows without commit metadata."""
    share = 100 * F.avg((F.col("feature_source") == "job_sequence").cast("double"))
    return df.groupBy("repo").agg(F.count("*").alias("rows"), F.sum("label").alias("failures"), F.avg("label").alias("failure_rate"), share.alias("by_sequence_pct"), (100 * F.avg("commit_meta_missing")).alias("meta_missing_pct"))


def source_gate(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """source_shares of the repos in ``baselines`` (repo, baseline, kind, tolerance) and whether each is within its tolerance."""
    allowed = F.when(F.col("kind") == "relative", F.col("baseline") * F.col("tolerance")).otherwise(F.col("tolerance"))
    return source_shares(df).join(F.broadcast(baselines), "repo").withColumn("ok", F.abs(F.col("by_sequence_pct") - F.col("baseline")) <= allowed)


def monotonic(df: DataFrame) -> DataFrame:
    """(repo, test_id, ok): whether the timestamps never fall in the order of jobs: a stricter gate than in time order, where it cannot fail.

    A timestamp is held against the latest of all jobs before, carried over range partitions: no task holds a whole test.
    """
    rows = strictly_before(df.where(F.col("timestamp").isNotNull()).select("repo", "test_id", "job_sequence", "timestamp"), ["repo", "test_id"], "job_sequence", maxima={"_latest": F.col("timestamp")})
    return rows.groupBy("repo", "test_id").agg(F.bool_and(F.coalesce(F.col("timestamp") >= F.col("_latest"), F.lit(True))).alias("ok"))


def coverage_gate(coverage: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """(repo, sha_pct, row_pct, ok): whether enough of a repo's commits and rows have a time; both shares count."""
    return coverage.select("repo", "sha_pct", "row_pct", ((F.col("sha_pct") >= least) & (F.col("row_pct") >= least)).alias("ok"))


def require_coverage(coverage: DataFrame, least: float = LEAST_COVERAGE) -> None:
    """Raises ValueError naming a repo whose commits or rows have too few times."""
    bad = coverage_gate(coverage, least).where("not ok").orderBy("repo").first()
    if bad:
        raise ValueError(f"{bad['repo']}: {bad['sha_pct']:.1f}% of the commits and {bad['row_pct']:.1f}% of the rows have a time, at least {least:.0f}% is asked for")


def require_selected(marked: DataFrame, least: int = LEAST_PROJECTS) -> list[str]:
    """The projects whose ``status`` is SELECTED, by falling rate; raises ValueError where there are too few of them."""
    chosen = [r["repo"] for r in marked.where("status = 'SELECTED'").orderBy(F.desc("rate"), F.lower("repo")).select("repo").collect()]  # as many as the selection's limit
    if len(chosen) < least:
        raise ValueError(f"{len(chosen)} of at least {least} projects were chosen")
    return chosen


def validate_features(df: DataFrame, baselines: Mapping[str, tuple[float, str, float]] | None = None, in_order: bool = True) -> None:
    """Raises AssertionError at the first gate that fails: columns, rows, nulls, labels, sources, order in time, source shares, number of features.

    ``in_order`` False leaves the order of times out, for tables whose jobs are numbered otherwise than by time.
    """
    absent = sorted(set(REQUIRED) - set(df.columns))
    assert not absent, f"the matrix lacks {', '.join(absent)}"
    checked = [c for c in df.columns if c not in MAY_BE_NULL]
    got = df.agg(
        F.count("*").alias("_rows"),
        F.count_if(~F.col("label").isin(0, 1)).alias("_labels"),
        F.count_if(~F.col("feature_source").isin(*SOURCES)).alias("_sources"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in checked],
    ).first()
    assert got["_rows"] > 0, "the matrix has no rows"
    sparse = {c: round(got[c], 4) for c in checked if got[c] > MOST_NULLS}
    assert not sparse, f"too many nulls, as shares: {sparse}"
    assert got["_labels"] == 0, f"{got['_labels']} rows have a label other than 0 and 1"
    assert got["_sources"] == 0, f"{got['_sources']} rows name an unknown source of author features"
    if in_order:
        falling = monotonic(df).where("not ok").select("repo", "test_id").first()
        assert falling is None, f"times fall from one job to the next, as for {falling and tuple(falling)}"
    if baselines:
        table = df.sparkSession.createDataFrame([(r, *v) for r, v in baselines.items()], "repo string, baseline double, kind string, tolerance double")
        off = sorted(r["repo"] for r in source_gate(df, table).where("not ok").collect())  # at most the baselines
        assert not off, f"shares of sequence-based author features are off their baselines in {', '.join(off)}"
    features = set(df.columns) - set(NO_FEATURES)
    assert len(features) >= LEAST_FEATURES, f"{len(features)} of at least {LEAST_FEATURES} features"


def require_no_nulls(df: DataFrame, exempt: tuple[str, ...] = ("timestamp", "commit_sha")) -> None:
    """Raises ValueError if a column outside ``exempt`` holds a null."""
    got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns if c not in exempt]).first()
    bad = {c: n for c, n in got.asDict().items() if n}
    if bad:
        raise ValueError(f"unexpected nulls: {bad}")
