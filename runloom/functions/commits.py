"""What a commit reference names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.keys import is_sha, is_short_sha, reference


def known_commits(commits: DataFrame) -> DataFrame:
    """(repo, sha, committed_ts): one row per repo and sha, deleted or not; the least committed_ts of repeated rows."""
    rows = commits.select("repo", reference().alias("sha"), "committed_ts").where(is_sha(F.col("sha")) & F.col("repo").isNotNull())
    return rows.groupBy("repo", "sha").agg(F.min("committed_ts").alias("committed_ts"))


def short_names(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, ref, sha, committed_ts) for the short references among ``refs`` (repo, ref): the commits of the repo whose sha begins so."""
    short = refs.where(is_short_sha(F.col("ref"))).select("repo", "ref", F.substring("ref", 1, 7).alias("key")).distinct()
    of = known.select(F.col("repo").alias("c_repo"), "sha", "committed_ts", F.substring("sha", 1, 7).alias("c_key"))
    on = (F.col("repo") == F.col("c_repo")) & (F.col("key") == F.col("c_key")) & F.col("sha").startswith(F.col("ref"))
    return short.join(of, on).select("repo", "ref", "sha", "committed_ts")


def commit_times(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, ref, committed_ts), unique per repo and ref, for full and short references."""
    short = short_names(refs, known).groupBy("repo", "ref").agg(F.min("committed_ts").alias("committed_ts"))
    return known.select("repo", F.col("sha").alias("ref"), "committed_ts").unionByName(short)
