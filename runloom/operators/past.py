"""Aggregates over all earlier rows of a key, for keys too large for one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import stored


def strictly_before(df: DataFrame, keys: Sequence[str], time: str, sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, distinct: bool = False) -> DataFrame:
    """``df`` with each of ``sums`` (0 if none) and ``maxima`` (null if none) over the rows of the same keys with a smaller ``time``.

    The rows are range-partitioned by keys and time, so a key of any size lies in as many partitions as it needs, and
    rows of one time in one of them. Each partition aggregates its own rows; what came before it in a key is one row
    per partition and key. Times are whole numbers; ``distinct``: no two rows of a key have the same time, which may
    then be of any type.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    rows = df.withColumns({f"_v_{n}": c for n, c in {**sums, **maxima}.items()})
    rows = stored(rows.repartitionByRange(*keys, time).withColumn("_part", F.spark_partition_id()), "ranged")
    total = lambda n: F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_p_{n}")
    per = rows.groupBy("_part", *keys).agg(*map(total, sums), *[F.max(f"_v_{n}").alias(f"_p_{n}") for n in maxima])
    parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("_part", *keys, *[F.coalesce(F.sum(f"_p_{n}").over(parts), F.lit(0)).alias(f"_c_{n}") for n in sums], *[F.max(f"_p_{n}").over(parts).alias(f"_c_{n}") for n in maxima])
    here = Window.partitionBy("_part", *keys).orderBy(time)
    here = (here.rowsBetween if distinct else here.rangeBetween)(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_h_{n}": F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)) for n in sums} | {f"_h_{n}": F.max(f"_v_{n}").over(here) for n in maxima})
    same = F.col("_part") == F.col("_c_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    out = rows.join(carried.withColumnsRenamed({k: f"_c_{k}" for k in keys} | {"_part": "_c_part"}), same)
    return out.select(*df.columns, *[(F.col(f"_h_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums], *[F.coalesce(f"_h_{n}", f"_c_{n}").alias(n) for n in maxima])


def before_each(points: DataFrame, events: DataFrame, keys: Sequence[str], time: str, sums: Mapping[str, Column]) -> DataFrame:
    """(keys, time, sums...) for the distinct ``points``: the sums over ``events`` of the same keys with a smaller time."""
    both = events.select(*keys, time, *[c.alias(f"_e_{n}") for n, c in sums.items()], F.lit(False).alias("_point"))
    both = both.unionByName(points.select(*keys, time).distinct().withColumn("_point", F.lit(True)), allowMissingColumns=True)
    out = strictly_before(both, keys, time, {n: F.coalesce(f"_e_{n}", F.lit(0)) for n in sums})
    return out.where("_point").select(*keys, time, *sums)


def trailing_rows(df: DataFrame, keys: Sequence[str], position: str, n: int, aggregates: Mapping[str, Column], block: int = 1_000_000) -> DataFrame:
    """``df`` with aggregates over each row and the n - 1 before it by ``position`` (1, 2, ... within the keys).

    Positions are cut into blocks; the last n - 1 rows of a block go to the next one too, where they only lend their values.
    """
    at = F.floor(F.col(position) / block)
    lent = (F.col(position) % block >= block - n + 1) & F.lit(n > 1)
    copies = F.when(lent, F.array(at, at + 1)).otherwise(F.array(at))
    rows = df.withColumn("_at", at).withColumn("_block", F.explode(copies))
    frame = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(1 - n, 0)
    return rows.withColumns({k: c.over(frame) for k, c in aggregates.items()}).where("_at = _block").drop("_at", "_block")


def exact_percentiles(df: DataFrame, by: str, value: str, points: Sequence[float]) -> DataFrame:
    """(by, n, p0, p1, ...): the exact percentiles of ``value`` (nulls left out), between two values in proportion.

    Equal values are counted first; their ranks come from counts carried over range partitions, so no task holds a
    whole group however many values it has.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_k"))
    placed = strictly_before(counts, [by], value, {"_below": F.col("_k")}, distinct=True)
    sizes = counts.groupBy(by).agg(F.sum("_k").alias("n"))
    rows = placed.join(sizes, by)
    out = []
    for i, p in enumerate(points):
        at = (F.col("n") - 1) * F.lit(float(p))
        holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_k"))
        out += [F.max(F.when(holds(F.floor(at)), F.col(value))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at)), F.col(value))).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_part{i}")]
    got = rows.groupBy(by).agg(F.max("n").alias("n"), *out)
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(f"p{i}") for i in range(len(points))]
    return got.select(by, "n", *between)


def percent_ranks(df: DataFrame, by: str, value: str) -> DataFrame:
    """``df`` with ``pct``: the share of the other rows of the same ``by`` with a smaller value (0 for a single row); ranks as above."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("_k"))
    placed = strictly_before(counts, [by], value, {"_below": F.col("_k")}, distinct=True).drop("_k")
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    same = (F.col(by) == F.col("_b")) & F.col(value).eqNullSafe(F.col("_v"))
    rows = df.join(placed.withColumnsRenamed({by: "_b", value: "_v"}), same).drop("_b", "_v").join(sizes, by)
    return rows.withColumn("pct", F.coalesce(F.try_divide(F.col("_below").cast("double"), F.col("_n") - 1), F.lit(0.0))).drop("_below", "_n")
