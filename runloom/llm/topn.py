"""The N highest-scoring items of every group.

Every task turns its rows into a sorted run, ordered by group and score, and keeps of each group only the first N:
no other row of the run can be among the N of the whole. What is left of a group in a run is one row, a segment of at most
N scores and ties in order. The segments are stored bucketed by group, so that reading a bucket needs no further
shuffle; a loser tree merges a group's segments and, after N outputs, seeks the next group. A group of any size
reaches its merging task as one segment per run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import work_dir


class LoserTree:
    """Merge of sorted sequences: each inner node keeps the loser of its match, so the next winner costs one path up."""

    END = (float("inf"), float("inf"))

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs or [[]]
        self.at, self.size = [0] * len(self.runs), len(self.runs)
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _head(self, run: int) -> tuple:
        at = self.at[run]
        return self.runs[run][at] if at < len(self.runs[run]) else self.END

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._head(b) < self._head(a):
            a, b = b, a
        self.losers[node] = b
        return a

    def pop(self) -> tuple | None:
        run = self.winner
        item = self._head(run)
        if item is self.END:
            return None
        self.at[run] += 1
        node = (run + self.size) // 2
        while node:
            other = self.losers[node]
            if self._head(other) < self._head(run):
                self.losers[node], run = run, other
            node //= 2
        self.winner = run
        return item


def _first_rows(keys: np.ndarray, held: object, count: int, n: int) -> tuple[np.ndarray, int]:
    """Which rows are among the first n of their group; the group ``held`` has had ``count`` rows already."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lengths = np.diff(np.append(first, len(keys)))
    rank = np.arange(len(keys)) - np.repeat(first, lengths)
    before = count if keys[0] == held else 0
    rank[: lengths[0]] += before
    return rank < n, int(lengths[-1] + (before if len(first) == 1 else 0))


def _segments(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    """The kept rows (group, score, tie) of a sorted batch, one row per group with its scores and ties as lists."""
    kept = batch.filter(pa.array(keep))
    keys = kept.column(0).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    ends = pa.array(np.append(first, len(keys)).astype(np.int32))
    return pa.RecordBatch.from_arrays([kept.column(0).take(pa.array(first)), pa.ListArray.from_arrays(ends, kept.column(1)), pa.ListArray.from_arrays(ends, kept.column(2))], ["g", "scores", "ties"])


def _cut(n: int):
    """From a task's rows in order of group and falling score to the segments of its run; a group cut by the end of a batch makes two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = None, 0
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                keep, count = _first_rows(keys, held, count, n)
                held = keys[-1]
                yield _segments(batch, keep)

    return run


def _merge(n: int, names: list[str]):
    """From segments in order of group to the first n items of each group."""

    def first(group: object, segments: list[list[tuple]]) -> list[tuple]:
        tree, out = LoserTree(segments), []
        while len(out) < n and (item := tree.pop()) is not None:
            out.append((group, -item[0], item[1], len(out) + 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, segments = None, []
        for batch in batches:
            types, out = [batch.schema.field(0).type, pa.float64(), pa.int64(), pa.int64()], []
            for g, scores, ties in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if g != group:
                    out += first(group, segments)
                    group, segments = g, []
                segments.append([(-s, t) for s, t in zip(scores, ties)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names)
        if segments:
            out = first(group, segments)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` stored in the shared folder as a table of as many buckets of ``column`` as a shuffle has partitions, and read back.

    Each bucket is written by one task, as one file. The name in the catalog is only lent: the files stay until ``clear``.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/{table}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # the path makes it an external table: its files are not touched
    return out


def top_n(rows: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """(group, score, tie, rank): of each group the n rows of greatest score, equal scores by smaller ``tie`` (bigint).

    Rows with a null group, a null or NaN score or a null tie are left out; repeated rows count each, in any order.
    Groups of fewer than n rows come out whole; an empty table gives no rows; other columns are not carried.
    """
    kind = rows.schema[group].dataType.simpleString()
    rows = rows.where(F.col(group).isNotNull() & F.col(tie).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = rows.select(F.col(group).alias("g"), F.col(score).cast("double").alias("score"), F.col(tie).cast("bigint").alias("tie"))
    runs = rows.sortWithinPartitions("g", F.desc("score"), "tie").mapInArrow(_cut(n), f"g {kind}, scores array<double>, ties array<bigint>")
    # Numbered, the segments of a group lie together; the buckets make it a sort inside each task.
    segments = bucketed(runs, "g", "runs").withColumn("no", F.row_number().over(Window.partitionBy("g").orderBy("g")))
    return segments.select("g", "scores", "ties", "no").mapInArrow(_merge(n, [group, score, tie, "rank"]), f"{group} {kind}, {score} double, {tie} bigint, rank bigint")
