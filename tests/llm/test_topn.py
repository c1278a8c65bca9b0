import random

from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm.topn import LoserTree, top_n
from tests.conftest import rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree_merges(runs):
    tree = LoserTree([[(x,) for x in sorted(r)] for r in runs])
    out = []
    while (item := tree.pop()) is not None:
        out.append(item[0])
    assert out == sorted(x for r in runs for x in r)


def brute(data, n):
    groups = {}
    for g, s, t in data:
        if g is not None and s is not None and s == s and t is not None:
            groups.setdefault(g, []).append((-s, t))
    return sorted(((g, -s, t, k) for g, v in groups.items() for k, (s, t) in enumerate(sorted(v)[:n], 1)), key=repr)


def test_hot_group_ties_nulls_and_repeats(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1.0, 2.0, 3.0, None, float("nan"), float("inf")]), rng.randrange(300)) for _ in range(3000)]
    data += [("one", 5.0, 1), ("null", None, 2), ("twice", 1.0, 7), ("twice", 1.0, 7), ("id", 1.0, None)]
    df = spark.createDataFrame([(*r, "x") for r in data], "g string, score double, id bigint, rank string").repartition(7)
    assert rows(top_n(df, "g", "score", "id", 5)) == brute(data, 5)
    assert rows(top_n(df, "g", "score", "id", 1)) == brute(data, 1)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, s double, id bigint"), "g", "s", "id", 5).count() == 0


def test_many_groups_over_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(2)
        data = [(f"g{rng.randrange(40)}", float(rng.randrange(9)), k) for k in range(800)]
        df = spark.createDataFrame(data, "g string, s double, id bigint").repartition(5)
        assert rows(top_n(df, "g", "s", "id", 3)) == brute(data, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
