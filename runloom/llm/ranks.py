"""Numbering the rows of a class without meeting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 250_000


def numbered(rows: DataFrame, kind: str, *order: str) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... within each ``kind``; (kind, order...) should tell the rows apart.

    A kind is numbered in hash buckets that are put one after the other by their counts, as many as the rows need, so a kind
    with a third of all rows takes many tasks. ``rows`` is read several times: it should be a stored table.
    """
    buckets = 1 + rows.count() // BUCKET_ROWS
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(kind, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(kind).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(kind, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(kind, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(offsets, [kind, "_bucket"]).withColumn("place", F.col("_before") + F.col("place")).drop("_before", "_bucket")
