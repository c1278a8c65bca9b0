import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from runloom.llm import packing
from runloom.llm.ranks import numbered


def test_fullest_against_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randrange(1, 20) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 50)
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room)
        got = packing.fullest(Counter(items), room)
        assert sum(k * n for k, n in got.items()) == best and not Counter(got) - Counter(items)


def test_plan_places_every_item_once():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 101) for _ in range(3000))
    plan = packing.packing_plan(counts, 100)
    used = Counter()
    for chosen, times in plan:
        assert sum(k * n for k, n in chosen.items()) <= 100
        for k, n in chosen.items():
            used[k] += n * times
    assert used == counts and len(plan) <= 100
    bins = sum(t for _, t in plan)
    assert bins <= sum(k * n for k, n in counts.items()) / 100 * 1.02
    assert packing.packing_plan({}, 100) == []


@pytest.mark.parametrize("hot", [0, 3])
def test_pack(spark, hot):
    rng = random.Random(3)
    sizes = [rng.choice([hot, rng.randrange(0, 30), rng.randrange(40, 95), 32, 33]) for _ in range(900)] + [None]
    df = spark.createDataFrame([(k, s, 5) for k, s in enumerate(sizes)], "doc_id bigint, tokens bigint, length int")
    got = packing.pack(df, "doc_id", "tokens", 32).collect()
    assert len(got) == len({(r.doc_id, r.piece) for r in got})
    whole, filled = Counter(), Counter()
    for r in got:
        whole[r.doc_id] += r.length
        filled[r.container] += r.length
    assert set(whole) == {k for k, s in enumerate(sizes) if s is not None} and all(whole[k] == sizes[k] for k in whole)
    assert max(filled.values()) <= 32
    split = {r.doc_id for r in got if r.piece > 0}
    assert split == {k for k, s in enumerate(sizes) if s is not None and s > 32}
    assert len(filled) <= sum(s for s in sizes if s) / 32 * 1.05 + 1


def test_shards_and_levels(spark):
    """Many small shards, whose loose containers are merged over levels, waste hardly more than one search over all."""
    rng = random.Random(5)
    sizes = [rng.choice([0, rng.randrange(1, 60), rng.randrange(60, 101)]) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k bigint, n bigint")
    got = packing.pack(df, "k", "n", 100, shard=32).collect()
    load, seen = Counter(), Counter()
    for r in got:
        load[r.container] += r.length
        seen[r.k] += r.length
    assert seen == Counter(dict(enumerate(sizes))) and max(load.values()) <= 100
    whole = sum(t for _, t in packing.packing_plan(Counter(s for s in sizes if s), 100))
    assert len(load) <= 1.02 * whole


def test_filled_places_each_item():
    import numpy as np

    rng = random.Random(7)
    lengths = np.array([rng.randrange(0, 50) for _ in range(500)])
    no = packing.filled(lengths, 64)
    assert np.bincount(no, weights=lengths).max() <= 64 and set(no) == set(range(no.max() + 1))
    assert packing.filled(lengths[:0], 64).size == 0 and packing.filled(np.zeros(3, dtype=int), 64).tolist() == [0, 0, 0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(df, "doc_id", "tokens", 32).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0)], "doc_id bigint, tokens bigint"), "doc_id", "tokens", 32).first().container == 0


def test_numbered(spark):
    df = spark.range(1000).withColumn("kind", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")))
    got = numbered(df, "kind", "id").collect()
    by = {}
    for r in got:
        by.setdefault(r.kind, []).append(r.place)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_repeated_rows_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 20), (1, 20), (2, 12), (2, 12), (3, 70)], "doc_id bigint, tokens bigint")
    got = packing.pack(df, "doc_id", "tokens", 32).collect()
    filled = Counter()
    for r in got:
        filled[r.container] += r.length
    assert sorted(filled.values()) == [6, 32, 32, 32, 32] and len(got) == 7
