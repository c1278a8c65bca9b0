import math
import os

import numpy as np
import pytest

from runloom.operators import evaluate
from runloom.plans import problems, reference
from runloom.session import stored
from tests.oracle import database, differ

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
QUERIES = {**reference.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.fixture(scope="module")
def whole_matrix(spark):
    return stored(reference.matrix_of(spark, DIR), "matrix")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name, whole_matrix, monkeypatch):
    if name != "feature_matrix":  # built anew for its own test only
        monkeypatch.setattr(reference, "matrix_of", lambda spark, d: whole_matrix)
    df = QUERIES[name](spark, DIR)
    if name in SQL:
        assert not differ(df, con, SQL[name])
    else:
        CHECKS[name](spark, con, df.toPandas())


def information(spark, con, got):
    """Against contingency tables made by hand: each feature is cut at its deciles."""
    m = reference.matrix_of(spark, DIR).select("label", *reference.NUMERIC).toPandas()
    y = m["label"].to_numpy()
    assert set(got["feature"]) == set(reference.NUMERIC)
    for f, value in zip(got["feature"], got["information"]):
        x = m[f].to_numpy(dtype=float)
        at = np.sort(x)
        cell = sum((x > c).astype(int) for c in {at[math.ceil(k * len(x) / 10) - 1] for k in range(1, 10)})
        table = np.zeros((11, 2))
        np.add.at(table, (cell, y), 1)
        p = table / len(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.nansum(p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))))
        assert value == pytest.approx(want, abs=1e-9), f


def top_information(spark, con, got):
    whole = QUERIES["label_information"](spark, DIR).toPandas().sort_values(["information", "feature"], ascending=[False, True]).head(5)
    assert got["feature"].tolist() == whole["feature"].tolist()


def measured(spark, order):
    return evaluate.apfd(reference.ranks(spark, DIR, order)).where("faults > 0").toPandas().set_index(["repo", "job_sequence"])["apfd"]


def interval(spark, con, got):
    values, (row,) = measured(spark, "mrf"), got.itertuples()
    wide = 1.96 * values.std() / len(values) ** 0.5
    assert row.mean == pytest.approx(values.mean()) and row.low < row.mean < row.high
    assert row.mean - row.low == pytest.approx(wide, rel=0.25) and row.high - row.mean == pytest.approx(wide, rel=0.25)


def signed_ranks(spark, con, got):
    d = (measured(spark, "mrf") - measured(spark, "random")).dropna()
    other = d[d != 0]
    rank = other.abs().round(9).rank()
    n, (row,) = len(other), got.itertuples()
    assert row.n == n and row.cohens_d == pytest.approx(d.mean() / d.std())
    assert row.wilcoxon_z == pytest.approx((rank[other > 0].sum() - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def learned(spark, con, got):
    assert len(got) == got["repo"].nunique() > 0
    shares = got.select_dtypes("float")
    assert ((shares >= 0) & (shares <= 1)).all().all()


def filled(spark, con, got):
    """Known cells stay as they are, absent ones are all filled and marked."""
    want = problems.fillable_runs(spark, DIR).toPandas().set_index("id").sort_index()
    got = got.set_index("id").sort_index()
    assert got.index.equals(want.index)
    for f in problems.FILLED:
        absent = want[f].isna()
        assert (got[f"{f}_filled"] == absent).all() and got[f].notna().all()
        assert np.allclose(got.loc[~absent, f].astype(float), want.loc[~absent, f].astype(float), atol=0.0006)
        assert got.loc[absent, f].astype(float).between(want[f].astype(float).min() - 0.001, want[f].astype(float).max() + 0.001).all()


CHECKS = {"label_information": information, "label_information_top5": top_information, "apfd_interval": interval, "order_difference": signed_ranks, "learned_order": learned, "p5_filled": filled}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
