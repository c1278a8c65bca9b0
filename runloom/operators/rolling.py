"""Totals and averages over trailing days for every entity and day, days without activity included.

The window is a two-stack queue over a monoid: values enter at the front stack, whose running aggregate is
kept, and leave from the back stack, whose suffix aggregates were computed when the front was last flipped over.
No value is ever subtracted, so aggregates that cannot be undone (max, min) work as well as sums. An element of the
queue is a day of many entities at once, each entity a lane that starts with its own first day: the lanes of a sorted
partition push, flip and pop together, as array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Monoid:
    """``combine`` is an associative numpy ufunc with identity ``zero``."""

    combine: np.ufunc
    zero: float


SLICE_DAYS = 500_000
SUM = Monoid(np.add, 0)
MAX = Monoid(np.maximum, -np.inf)
MIN = Monoid(np.minimum, np.inf)


class TwoStackQueue:
    """The active window of many lanes at once: what is pushed has one value (or row of values) per lane.

    Lanes that have ended drop out at the end: a push of fewer lanes than before narrows the queue.
    """

    def __init__(self, monoid: Monoid):
        self.combine, self.zero = monoid.combine, monoid.zero
        self.front: list[np.ndarray] = []
        self.back: list[np.ndarray] = []  # suffix aggregates, the oldest day's on top
        self.total: np.ndarray | None = None  # of the front
        self.lanes = 0

    def push(self, values: np.ndarray) -> None:
        self.lanes = len(values)
        self.front.append(values)
        self.total = values if self.total is None else self.combine(self.total[: self.lanes], values)

    def pop(self) -> None:
        if not self.back:  # flip
            kept = None
            for values in reversed(self.front):
                values = values[: self.lanes]
                kept = values if kept is None else self.combine(values, kept)
                self.back.append(kept)
            self.front, self.total = [], None
        self.back.pop()

    def aggregate(self) -> np.ndarray:
        if self.back and self.total is not None:
            return self.combine(self.back[-1][: self.lanes], self.total[: self.lanes])
        if self.back:
            return self.back[-1][: self.lanes]
        return self.total[: self.lanes]


def trailing(values: np.ndarray, starts: np.ndarray, days: int, monoid: Monoid) -> np.ndarray:
    """The aggregate of each value (or row of values) and the ``days - 1`` before it within its entity.

    ``starts``: where each entity's values begin. The longest entities come first, so that those which still have a
    day are always the first lanes.
    """
    lengths = np.diff(np.append(starts, len(values)))
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[order], lengths[order]
    lanes = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")  # how many have a k-th day
    out, queue = np.empty_like(values), TwoStackQueue(monoid)
    for k, n in enumerate(lanes):
        at = first[:n] + k
        queue.push(values[at])
        if k >= days:
            queue.pop()
        out[at] = queue.aggregate()
    return out


def trailing_totals(
    daily: DataFrame,
    entity: str,
    day: str,
    measures: Sequence[str],
    windows: Sequence[int] = (7, 30),
    maxima: Sequence[str] = (),
) -> DataFrame:
    """For each entity and each day from its first to its last: the measures of the day, and for each window of
    ``w`` days ``<measure>_<w>d`` (total) and ``<measure>_avg_<w>d`` (total / w); for ``maxima`` ``<name>_max_<w>d``.

    ``daily`` has one row per entity and day (an integer) with activity, so an entity holds at most as many rows as
    the calendar has days, however many events it had. Days before an entity's first count as days without activity.
    Rows with a null entity or day are left out, null measures count as 0 (maxima: as none); other columns are not carried.
    """
    names = [*measures, *maxima]
    kind = daily.schema[entity].dataType
    fields = [T.StructField(entity, kind), T.StructField(day, T.LongType()), T.StructField("active", T.BooleanType())]
    fields += [T.StructField(m, T.DoubleType()) for m in names]
    for w in windows:
        for m in measures:
            fields += [T.StructField(f"{m}_{w}d", T.DoubleType()), T.StructField(f"{m}_avg_{w}d", T.DoubleType())]
        fields += [T.StructField(f"{m}_max_{w}d", T.DoubleType()) for m in maxima]
    order = [f.name for f in fields]

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, at = pdf[entity].to_numpy(), pdf[day].to_numpy()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        last = np.append(first[1:], len(keys)) - 1
        span = at[last] - at[first] + 1
        starts = np.cumsum(span) - span
        place = at - np.repeat(at[first] - starts, last - first + 1)
        n = int(span.sum())
        out = {entity: np.repeat(keys[first], span), day: np.arange(n) - np.repeat(starts - at[first], span)}
        active = np.zeros(n, dtype=bool)
        active[place] = True
        out["active"] = active
        for kind, own in ((SUM, list(measures)), (MAX, list(maxima))):
            full = np.full((n, len(own)), float(kind.zero))
            for k, m in enumerate(own):
                got = pdf[m].to_numpy(dtype=float, na_value=np.nan)
                full[place, k] = np.where(np.isnan(got), kind.zero, got)
                out[m] = full[:, k]
            for w in windows if own else ():
                total = trailing(full, starts, w, kind)
                for k, m in enumerate(own):
                    if kind is MAX:
                        out[f"{m}_max_{w}d"] = np.where(np.isinf(total[:, k]), np.nan, total[:, k])
                    else:
                        out[f"{m}_{w}d"], out[f"{m}_avg_{w}d"] = total[:, k], total[:, k] / w
        for m in maxima:
            out[m] = np.where(np.isinf(out[m]), np.nan, out[m])
        return pd.DataFrame(out)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last entity of a batch may go on in the next
        for pdf in batches:
            if kept is not None:
                pdf = pd.concat([kept, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = pdf[entity].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            kept = pdf.iloc[cut:]
            if cut:
                yield from sliced(pdf.iloc[:cut])
        if kept is not None and len(kept):
            yield dense(kept)

    def sliced(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole entities at a time, few enough for their days to take little memory however far apart the active ones lie."""
        keys, at = pdf[entity].to_numpy(), pdf[day].to_numpy()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        last = np.append(first[1:], len(keys)) - 1
        part = np.cumsum(at[last] - at[first] + 1) // SLICE_DAYS
        cuts = first[np.flatnonzero(np.append(True, part[1:] != part[:-1]))]
        for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
            yield dense(pdf.iloc[a:b])

    rows = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, F.col(day).cast("bigint").alias(day), *[F.col(m).cast("double").alias(m) for m in names])
    return rows.repartition(entity).sortWithinPartitions(entity, day).mapInPandas(run, T.StructType(fields))


def daily_runs(runs: DataFrame) -> DataFrame:
    """Runs and failed runs of each test and day, and the longest run; combined before the shuffle."""
    return runs.groupBy("test_id", "day_no").agg(F.count("*").alias("runs"), F.sum(F.col("failed").cast("int")).alias("failed"), F.max("duration").cast("double").alias("duration"))


def day_of(ts: Column) -> Column:
    return F.floor(ts / 86400).cast("bigint")
