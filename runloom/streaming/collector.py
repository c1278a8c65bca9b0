"""Results as they arrive: a Structured Streaming intake, daily counts and the state of each test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runloom.functions.keys import failed, usable_timestamp
from runloom.operators.ingest import derived_outcome, insert_new
from runloom.session import work_dir
from runloom.sources.csv_rejects import load_results
from runloom.sources.projects import list_files

KEYS = ["repo", "job_id", "test_id"]
KEPT_IDS = 10_000


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream; it may be one file or a folder: only a pattern lets a stream read either."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def taken(spark: SparkSession, path: str, rows: DataFrame, part: str) -> DataFrame | None:
    """What the table at ``path``, partitioned by ``part``, has of the partitions that ``rows`` touch; None where there is no table yet.

    The values of ``part`` in a batch are those of its files; only their folders are listed and read.
    """
    if not list_files(spark, path):
        return None
    touched = [r[0] for r in rows.select(part).distinct().collect()]  # at most the files of one batch
    known = spark.read.schema(rows.schema).parquet(path)
    return known.where(F.col(part).isin([v for v in touched if v is not None]) | (F.col(part).isNull() if None in touched else F.lit(False)))


def collect_results(lines: DataFrame, target: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch of raw lines to ``target``, leaving out runs it has already, and failed lines to ``rejects``; both are
    partitioned by repo.

    A batch that is repeated after a failure adds nothing twice: its runs are found in the target, its lines in the
    rejects. Of these only the partitions of the batch's repos are read.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = load_results(batch).withColumn("repo", F.regexp_replace("file_name", r"\.csv$", "")).persist()
        runs = batch.where("reason is null").select("line_id", "job_id", "test_id", derived_outcome().alias("outcome"), "duration_ms", "repo")
        failed_lines = batch.where("reason is not null").select("line_id", "reason", "repo")
        for rows, path, keys in ((runs, target, KEYS), (failed_lines, rejects, ["line_id", "repo"])):
            known = taken(spark, path, rows, "repo")
            new = rows.dropDuplicates(keys) if known is None else insert_new(known, rows, keys)
            new.write.mode("append").partitionBy("repo").parquet(path)
        batch.unpersist()

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drifted(counts: DataFrame, since: int, days: int = 30, most: float = 0.1) -> DataFrame:
    """(repo, before, after, drifted): the failure rates of daily ``counts`` in the ``days`` before the day ``since`` and in those from it on, and
    whether they differ by more than ``most``: the check that runs once a day beside the intake."""
    side = F.when(F.col("day_no") >= since, "after").when(F.col("day_no") >= since - days, "before")
    of = lambda s: F.try_divide(F.sum(F.when(side == s, F.col("failed"))).cast("double"), F.sum(F.when(side == s, F.col("runs"))))
    rates = counts.groupBy("repo").agg(of("before").alias("before"), of("after").alias("after"))
    return rates.withColumn("drifted", F.coalesce(F.abs(F.col("after") - F.col("before")) > most, F.lit(False)))


def daily_counts(runs: DataFrame, late_days: int = 3650) -> DataFrame:
    """(repo, day, runs, failed) of a stream of test_runs rows by usable timestamp; rows later than the watermark are dropped by Spark."""
    rows = runs.select("repo", usable_timestamp().alias("t"), failed().cast("int").alias("failed")).where("t is not null")
    rows = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", f"{late_days} days")
    counts = rows.groupBy("repo", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("runs"), F.sum("failed").alias("failed"))
    return counts.select("repo", F.unix_date(F.col("w.start").cast("date")).cast("bigint").alias("day_no"), "runs", "failed")


def latest(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all there is now and returns its last complete result."""
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/{name}-{id(stream):x}-{pd.Timestamp.now().value:x}"
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/result-{number}"
        batch.write.mode("overwrite").parquet(path)
        last.append(path)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(last[-1]) if last else spark.createDataFrame([], schema)


def live_streaks(runs: DataFrame) -> DataFrame:
    """(repo, test_id, runs, streak, last_id) updated with each batch: the number of runs since the last failure.

    The state of a test is its number of runs, the greatest id of a failure and the runs beyond it, whatever the order of
    batches: a late row counts by its id. Runs beyond the last failure are held as ids, which the next failure clears;
    beyond KEPT_IDS of them only the newest are held, and a failure older than all these leaves the streak as it is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, dropped, last, bad, passed = state.get if state.exists else (0, 0, -1, -1, [])
        held = [np.asarray(passed, dtype=np.int64)]
        for rows in batches:
            ids, fail = rows["id"].to_numpy(dtype=np.int64), rows["failed"].to_numpy(dtype=bool)
            n, last = n + len(ids), max(last, int(ids.max(initial=-1)))
            worst = int(ids[fail].max(initial=-1))
            if worst > bad:
                bad = worst
                if len(held[0]) and worst >= held[0][0]:
                    dropped = 0
            held.append(ids[~fail])
        beyond = np.sort(np.concatenate(held))
        beyond = beyond[beyond > bad]
        over = max(0, len(beyond) - KEPT_IDS)
        dropped, beyond = dropped + over, beyond[over:]
        state.update((n, dropped, last, bad, beyond.tolist()))
        yield pd.DataFrame({"repo": [key[0]], "test_id": [key[1]], "runs": [n], "streak": [dropped + len(beyond)], "last_id": [last]})

    rows = runs.select("repo", "test_id", "id", failed().alias("failed")).where("repo is not null and test_id is not null")
    out = "repo string, test_id string, runs bigint, streak bigint, last_id bigint"
    return rows.groupBy("repo", "test_id").applyInPandasWithState(step, out, "runs bigint, dropped bigint, last bigint, bad bigint, passed array<bigint>", "update", GroupStateTimeout.NoTimeout)
