"""Splits along the order of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.sources.tables import require_columns


def split_sides(df: DataFrame, ratio: float = 0.8, by: str = "repo", sequence: str = "job_sequence") -> DataFrame:
    """``df`` with ``side``: train up to the job floor(ratio * last job) of its repo, test after it, null without a sequence.

    The last job of each repo comes from an aggregate, so no repo is sorted or gathered; the repos are few beside
    the rows and join back by AQE's choice.
    """
    last = df.groupBy(by).agg(F.floor(F.lit(float(ratio)) * F.max(sequence)).cast("bigint").alias("_last"))
    side = F.when(F.col(sequence) <= F.col("_last"), "train").when(F.col(sequence).isNotNull(), "test")
    return df.join(last, by).withColumn("side", side).drop("_last")


def temporal_split(df: DataFrame, ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one repo. Raises ValueError if a needed column is missing or there is not exactly one repo."""
    require_columns(df, {"repo", "job_sequence"})
    repos = [r[0] for r in df.select("repo").distinct().limit(2).collect()]
    if len(repos) != 1:
        raise ValueError("a temporal split takes the rows of exactly one repo")
    sides = split_sides(df, ratio)
    return sides.where("side = 'train'").drop("side"), sides.where("side = 'test'").drop("side")


def time_folds(jobs: DataFrame, k: int) -> DataFrame:
    """``jobs`` (repo, job_sequence: 1, 2, ...) with ``fold``: 0 for the first block, then 1..k; fold i is tested on a model of all
    blocks before it. Blocks are equal shares of the sequence, so no repo's jobs are sorted in one task."""
    last = jobs.groupBy("repo").agg(F.max("job_sequence").alias("_last"))
    return jobs.join(last, "repo").withColumn("fold", F.floor((F.col("job_sequence") - 1) * (k + 1) / F.col("_last")).cast("int")).drop("_last")


def union_projects(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
