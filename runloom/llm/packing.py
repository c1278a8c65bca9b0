"""Filling containers of fixed capacity with items of varying length.

Minimum bin slack: a container starts with the longest item left and is completed with the fullest feasible
combination of the others, found by a subset-sum over bitsets, which is then removed. Items of one length are alike, and the
same combination stays the fullest until one of its lengths runs out, so it is taken as often as the counts allow.

The search runs in tasks, each over a shard of the items that fills about ``SHARD`` containers. What a shard cannot
fill well, its few loosest containers, is opened again and searched with that of other shards, level by level in
fewer shards, until one is left; each level takes a sixteenth of the containers of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import stored

SHARD = 256  # containers that one search fills
LOOSE = 16  # containers of a shard that are opened again
SHARD_ITEMS = 200_000


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """How many of each length add up to as much as possible, but no more than ``room``."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length)
        if most <= 0:
            continue
        layers.append((length, reach))
        step = 1
        while most:  # multiples by doubling
            step = min(step, most)
            reach |= (reach << (step * length)) & mask
            most -= step
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            out[length] = n
    return out


def packing_plan(counts: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of containers filled with it) for the counts of each length from 1 to capacity."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        plan.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def pieces_of(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, length): an item within the capacity is one piece; a longer one is cut into full pieces and its rest."""
    last = F.floor((F.greatest(F.col(size), F.lit(1)) - 1) / capacity).cast("int")
    length = F.least(F.lit(capacity).cast("bigint"), F.col(size) - F.col("piece") * capacity)
    return items.select(key, size, F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(key, "piece", length.alias("length"))


def filled(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each item of one shard; items of length 0 are spread over the containers."""
    order = np.argsort(lengths, kind="stable")
    kinds, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    at = dict(zip(kinds.tolist(), first.tolist()))
    out, made = np.zeros(len(lengths), dtype=np.int64), 0
    for chosen, times in packing_plan({k: n for k, n in zip(kinds.tolist(), counts.tolist()) if k > 0}, capacity):
        for length, n in chosen.items():
            out[order[at[length] : at[length] + n * times]] = made + np.arange(n * times) // n
            at[length] += n * times
        made += times
    none = lengths == 0
    out[none] = np.arange(none.sum()) % max(1, made)
    return out


def searching(capacity: int, loose: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Fills the containers of one shard and marks the items of its ``loose`` least filled ones, if they have room."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        no = filled(lengths, capacity)
        load = np.bincount(no, weights=lengths)
        least = np.argsort(load, kind="stable")[:loose]
        opened = np.zeros(len(load), dtype=bool)
        opened[least] = load[least] < capacity
        return pdf.assign(no=no, loose=opened[no])

    return search


def pack(items: DataFrame, key: str, size: str, capacity: int, shard: int = SHARD) -> DataFrame:
    """(key, piece, length, container): each piece's container, a number; no container holds more than ``capacity``.

    Items with a null size are left out; those of size 0 need no room and are spread over the containers; repeated keys
    are items of their own; other columns are not carried. The driver sees the number of items and the sum of their lengths.
    """
    pieces = pieces_of(items.where(F.col(size).isNotNull()), key, size, capacity).withColumn("row", F.monotonically_increasing_id())
    rest = stored(pieces, "pieces")
    total = rest.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    shards = max(1, -(-(total["length"] or 0) // (shard * capacity)), -(-total["n"] // SHARD_ITEMS))
    kind = items.schema[key].dataType.simpleString()
    done, level = None, 0
    while True:
        last = shards == 1
        sharded = rest.select(key, "piece", "length", "row", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).alias("shard"))
        found = stored(sharded.groupBy("shard").applyInPandas(searching(capacity, 0 if last else LOOSE), f"{key} {kind}, piece int, length bigint, row bigint, shard bigint, no bigint, loose boolean"), "packed")
        number = F.lit(level << 58) + F.col("shard") * (1 << 24) + F.col("no")
        closed = found.where("not loose").select(key, "piece", "length", number.alias("container"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        rest, level, shards = found.where("loose"), level + 1, max(1, shards * LOOSE // shard)
