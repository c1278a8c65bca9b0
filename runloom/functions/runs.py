"""Runs: all rows with one job number and test_id, given by the row with the least id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.keys import run_key


def distinct_runs(test_runs: DataFrame, **values: Column) -> DataFrame:
    """(test_id, id, values...) of each run, taken from its row with the least id.

    One shuffle on (job, test_id), which is spread evenly even if one test_id or one job holds a third of the
    rows. Rows without a test_id belong to no test and are left out; rows whose job_id is no number are runs of
    their own; an empty table gives no runs.
    """
    rows = test_runs.where(F.col("test_id").isNotNull()).select(run_key().alias("_job"), "test_id", F.struct(F.col("id"), *[v.alias(k) for k, v in values.items()]).alias("_row"))
    first = rows.repartition("_job", "test_id").groupBy("_job", "test_id").agg(F.min("_row").alias("_row"))
    return first.select("test_id", "_row.*")
