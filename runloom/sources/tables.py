"""The given tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "the table") -> DataFrame:
    """``df`` itself; raises ValueError naming the columns it lacks."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df
