import random

import pytest
from pyspark.sql import functions as F

from runloom.operators.past import before_each, strictly_before, trailing_rows


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    return [(k, rng.choice(["hot", "hot", "hot", "b", "c"]), rng.randrange(150), rng.randrange(9)) for k in range(600)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id int, g string, t bigint, v int").repartition(5)


def test_strictly_before(frame, data):
    got = {r.id: r for r in strictly_before(frame, ["g"], "t", {"s": F.col("v")}, {"m": F.struct("t", "v")}).collect()}
    assert len(got) == len(data)
    for k, g, t, _ in data:
        prior = [(x[2], x[3]) for x in data if x[1] == g and x[2] < t]
        assert got[k].s == sum(v for _, v in prior)
        assert got[k].m == (max(prior) if prior else None)


def test_before_each(spark, frame, data):
    points = spark.createDataFrame([("hot", 70), ("hot", 70), ("hot", -1), ("b", 10**6), ("new", 5)], "g string, t bigint")
    got = {(r.g, r.t): r.n for r in before_each(points, frame, ["g"], "t", {"n": F.lit(1)}).collect()}
    count = lambda g, t: sum(x[1] == g and x[2] < t for x in data)
    assert got == {(g, t): count(g, t) for g, t in [("hot", 70), ("hot", -1), ("b", 10**6), ("new", 5)]}


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_trailing_rows(spark, block):
    df = spark.createDataFrame([("a", k, k * k % 17) for k in range(1, 60)] + [("b", 1, 5)], "g string, p int, v int")
    got = {(r.g, r.p): r.s for r in trailing_rows(df, ["g"], "p", 4, {"s": F.sum("v")}, block).collect()}
    assert got == {("a", k): sum(j * j % 17 for j in range(max(1, k - 3), k + 1)) for k in range(1, 60)} | {("b", 1): 5}


def test_exact_percentiles_and_ranks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from runloom.operators.past import exact_percentiles, percent_ranks

    rng = np.random.default_rng(5)
    data = [(k, float(x)) for k, n in (("a", 501), ("b", 2), ("c", 1)) for x in np.round(rng.random(n) * 40) / 7] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    for r in exact_percentiles(df, "k", "v", (0.0, 0.5, 0.95, 0.99, 1.0)).collect():
        own = [v for k, v in data if k == r.k and v is not None]
        assert r.n == len(own) and [r.p0, r.p1, r.p2, r.p3, r.p4] == np.percentile(own, [0, 50, 95, 99, 100]).tolist()
    whole = df.where("k is not null and v is not null").withColumn("id", F.monotonically_increasing_id()).persist()
    for r in percent_ranks(whole, "k", "v").collect():
        own = [v for k, v in data if k == r.k and v is not None]
        assert abs(r.pct - (sum(v < r.v for v in own) / (len(own) - 1) if len(own) > 1 else 0.0)) < 1e-12
    assert percent_ranks(whole, "k", "v").count() == 504
