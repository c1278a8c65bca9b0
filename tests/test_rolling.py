import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.functions.runs import distinct_runs
from runloom.operators import rolling
from tests.conftest import rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40), min_size=1, max_size=5), st.integers(1, 12))
def test_trailing_equals_brute_force(entities, days):
    values = np.array([v for e in entities for v in e], dtype=float)
    starts = np.cumsum([0, *[len(e) for e in entities[:-1]]])
    for monoid, f in ((rolling.SUM, sum), (rolling.MAX, max), (rolling.MIN, min)):
        want = [[f(v[i] for v in e[max(0, k - days + 1) : k + 1]) for i in (0, 1)] for e in entities for k in range(len(e))]
        assert rolling.trailing(values, starts, days, monoid).tolist() == want
        assert rolling.trailing(values[:, 0], starts, days, monoid).tolist() == [w[0] for w in want]
    assert rolling.trailing(values[:0], starts[:0], days, rolling.SUM).size == 0


def test_queue():
    q = rolling.TwoStackQueue(rolling.MAX)
    q.push(np.array([3.0, 1.0, 9.0]))
    q.push(np.array([2.0, 5.0]))  # the third lane has ended
    assert q.aggregate().tolist() == [3.0, 5.0]
    q.pop()
    assert q.aggregate().tolist() == [2.0, 5.0] and not q.front
    q.push(np.array([1.0]))
    assert q.aggregate().tolist() == [2.0]
    q.pop()
    assert q.aggregate().tolist() == [1.0] and not q.back


def test_days_without_activity(spark):
    rng = random.Random(1)
    data = {(e, day): (rng.randrange(5), rng.choice([None, 3.0, 9.0])) for e in "abc" for day in rng.sample(range(100), 20)}
    df = spark.createDataFrame([(e, d, n, x, "clash") for (e, d), (n, x) in data.items()], "e string, d bigint, n bigint, x double, active string")
    got = {(r.e, r.d): r for r in rolling.trailing_totals(df, "e", "d", ["n"], (7, 30), maxima=["x"]).collect()}
    for e in "abc":
        days = [d for (k, d) in data if k == e]
        assert {d for (k, d) in got if k == e} == set(range(min(days), max(days) + 1))
    for (e, d), r in got.items():
        inside = [data[e, k] for k in range(d - 6, d + 1) if (e, k) in data]
        assert r.n_7d == sum(n for n, _ in inside) and abs(r.n_avg_7d - r.n_7d / 7) < 1e-12
        most = [x for _, x in inside if x is not None]
        assert (r.x_max_7d != r.x_max_7d or r.x_max_7d is None) if not most else r.x_max_7d == max(most)
        assert r.active == ((e, d) in data)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1, 1), ("a", None, 1), ("b", 4, None)], "e string, d bigint, n bigint")
    assert rows(rolling.trailing_totals(df, "e", "d", ["n"], (7,)), "e", "d", "n_7d") == [("b", 4, 0.0)]
    assert rolling.trailing_totals(df.limit(0), "e", "d", ["n"], (7,)).count() == 0


def test_distinct_runs(make_runs):
    df = make_runs([{"job_id": "7", "outcome": "FAIL"}, {"job_id": " 007.0", "outcome": "PASS"}, {"job_id": "?"}, {"job_id": "?"}, {"test_id": None}])
    from pyspark.sql import functions as F

    got = rows(distinct_runs(df, outcome=F.col("outcome")), "test_id", "id", "outcome")
    assert got == [("x.T", 1, "FAIL"), ("x.T", 3, "PASS"), ("x.T", 4, "PASS")]
