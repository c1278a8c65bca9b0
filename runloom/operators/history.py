"""What was known about a test strictly before each of its runs.

A test with very many runs in a repo has its history cut over many tasks (``hot_history``); for all others a window
does. There all frames share one partitioning and order, so there is one exchange and one sort. Rows of the same effective time
do not see each other: range frames end a second before. Counts over the last d days are differences of two growing
frames, which Spark computes incrementally, instead of sliding ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.keys import DAY_S
from runloom.operators.past import before_each, strictly_before, trailing_rows
from runloom.session import stored

WINDOW_DAYS = (7, 30, 90)
NEVER_DAYS = 999.0
LAST_RUNS = 20
HOT_RUNS = 1_000_000  # runs of one test in one repo from which on its history is cut over tasks
KEYS = ["repo", "test_id"]
COLUMNS = ("last_outcome", "failure_rate_7d", "failure_rate_30d", "failure_rate_90d", "days_since_last_fail", "days_since_last_run", "consecutive_passes", "avg_duration_ms", "duration_variance", "run_count_30d")


def test_history(runs: DataFrame, carry: tuple[str, ...] = ("id",), hot_runs: int = HOT_RUNS, is_stored: bool = False) -> DataFrame:
    """``carry`` and the ten history columns. runs: repo, test_id, ets, job_sequence, failed, duration_ms.

    A test without earlier runs has -1, 999 or 0. Rates are of the rows in [t - d days, t); the last durations are
    those of the last 20 rows, nulls among them ignored; variance is that of the population, 0 below two values.
    Raises where ets is null: such rows have no place on the time axis.
    """
    needed = dict.fromkeys([*carry, *KEYS, "ets", "job_sequence", "failed", "duration_ms"])
    placed = F.coalesce("ets", F.raise_error(F.lit("a run has neither a timestamp nor a job_sequence")).cast("bigint"))
    runs = runs.withColumn("ets", placed).select(*needed)
    runs = runs if is_stored else stored(runs, "runs")  # read twice
    hot = runs.groupBy(*KEYS).count().where(F.col("count") > hot_runs).select(*KEYS)
    if not hot.limit(1).count():
        return windowed_history(runs, carry)
    return windowed_history(runs.join(hot, KEYS, "left_anti"), carry).unionByName(hot_history(runs.join(hot, KEYS, "left_semi"), carry))


def hot_history(runs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The same for tests whose runs no single task should hold: running aggregates over range partitions."""
    fail = F.col("failed")
    rows = strictly_before(runs, KEYS, "ets", {"_count": F.lit(1), "_fails": fail})
    rows = rows.withColumn("_pos", F.col("_count") + F.row_number().over(Window.partitionBy(*KEYS, "ets").orderBy("job_sequence")))
    rows = trailing_rows(rows, KEYS, "_pos", LAST_RUNS, {"_mean": F.avg("duration_ms"), "_var": F.var_pop("duration_ms"), "_n": F.count("duration_ms")})
    state = F.struct("_pos", "ets", "failed", "_mean", "_var", "_n")
    rows = strictly_before(rows, KEYS, "ets", maxima={"_last": state, "_bad": F.when(fail == 1, F.struct("_pos", "ets"))})
    for d in WINDOW_DAYS:
        rows = rows.withColumn("_since", F.col("ets") - d * DAY_S)
        older = before_each(rows.select(*KEYS, F.col("_since").alias("ets")), runs, KEYS, "ets", {"_n_old": F.lit(1), "_f_old": fail}).withColumnRenamed("ets", "_since")
        rows = rows.join(older, [*KEYS, "_since"]).withColumn(f"_count_{d}", F.col("_count") - F.col("_n_old")).withColumn(f"_fails_{d}", F.col("_fails") - F.col("_f_old")).drop("_since", "_n_old", "_f_old")
    rows = rows.withColumn("_fail_at", F.col("_bad.ets")).withColumn("_streak", F.col("_count") - F.coalesce("_bad._pos", F.lit(0)))
    return columns_of(rows, carry, F.col("_streak").cast("int"))


def windowed_history(runs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    key = Window.partitionBy("repo", "test_id")
    by_row = key.orderBy("ets", "job_sequence")
    by_time = key.orderBy("ets")
    prior = by_time.rangeBetween(Window.unboundedPreceding, -1)
    to_here = by_row.rowsBetween(Window.unboundedPreceding, 0)
    recent = by_row.rowsBetween(1 - LAST_RUNS, 0)
    fail = F.col("failed")

    rows = runs.withColumn("_pos", F.row_number().over(by_row))
    rows = rows.withColumn("_streak", F.col("_pos") - F.coalesce(F.max(F.when(fail == 1, F.col("_pos"))).over(to_here), F.lit(0)))
    rows = rows.withColumn("_mean", F.avg("duration_ms").over(recent)).withColumn("_var", F.var_pop("duration_ms").over(recent)).withColumn("_n", F.count("duration_ms").over(recent))
    state = F.struct("ets", "job_sequence", "failed", "_streak", "_mean", "_var", "_n")
    rows = rows.withColumn("_last", F.max(state).over(prior)).withColumn("_fail_at", F.max(F.when(fail == 1, F.col("ets"))).over(prior))
    rows = rows.withColumn("_count", F.count("*").over(prior)).withColumn("_fails", F.coalesce(F.sum(fail).over(prior), F.lit(0)))
    for d in WINDOW_DAYS:
        older = by_time.rangeBetween(Window.unboundedPreceding, -d * DAY_S - 1)
        rows = rows.withColumn(f"_count_{d}", F.col("_count") - F.count("*").over(older)).withColumn(f"_fails_{d}", F.col("_fails") - F.coalesce(F.sum(fail).over(older), F.lit(0)))
    return columns_of(rows, carry, F.coalesce("_last._streak", F.lit(0)))


def columns_of(rows: DataFrame, carry: tuple[str, ...], streak: Column) -> DataFrame:
    days = lambda c: F.coalesce(F.greatest(F.lit(0.0), (F.col("ets") - F.col(c)) / F.lit(float(DAY_S))), F.lit(NEVER_DAYS))
    since = lambda c: F.when(F.col(c).isNull(), F.lit(NEVER_DAYS)).otherwise(days(c))
    return rows.select(
        *carry,
        F.coalesce("_last.failed", F.lit(-1)).alias("last_outcome"),
        *[F.when(F.col(f"_count_{d}") > 0, F.col(f"_fails_{d}") / F.col(f"_count_{d}")).otherwise(F.lit(-1.0)).alias(f"failure_rate_{d}d") for d in WINDOW_DAYS],
        since("_fail_at").alias("days_since_last_fail"),
        since("_last.ets").alias("days_since_last_run"),
        streak.alias("consecutive_passes"),
        F.coalesce("_last._mean", F.lit(0.0)).alias("avg_duration_ms"),
        F.when(F.col("_last._n") >= 2, F.col("_last._var")).otherwise(F.lit(0.0)).alias("duration_variance"),
        F.col("_count_30").alias("run_count_30d"),
    )
