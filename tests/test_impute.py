import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from runloom.operators import impute
from runloom.plans import problems

DIR = "/root/testdata/sf0.1"


def test_bins():
    b = impute.Bins.of([0, 1, 2, 3, 4, 5, 6])
    assert b.cuts == [1, 3, 5] and len(b.medians) == 4
    assert impute.Bins.of([5] * 9).cuts == [] and impute.Bins.of([5] * 9).medians == [5]
    assert impute.Bins.of(None).size == 0


def test_codes_of():
    assert impute.codes_of(np.array([np.nan, 0.0, 1.0, 2.9, 3.0, 5.0, 9.0]), [1.0, 3.0, 5.0]).tolist() == [-1, 0, 1, 1, 2, 3, 3]
    assert impute.codes_of(np.array([np.nan, 7.0]), []).tolist() == [-1, 0]


def tables_of(data, sizes):
    out = {}
    for a in range(len(sizes)):
        for b in range(a + 1, len(sizes)):
            t = np.zeros((sizes[a], sizes[b]))
            np.add.at(t, (data[:, a], data[:, b]), 1)
            out[a, b] = t
    return out


def test_tree_and_posterior_against_brute_force():
    rng = np.random.default_rng(1)
    n = 4000
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.85, a, rng.integers(0, 3, n))
    c = np.where(rng.random(n) < 0.85, b % 2, rng.integers(0, 2, n))
    d = np.where(rng.random(n) < 0.8, (b + 1) % 4, rng.integers(0, 4, n))
    data, sizes = np.stack([a, b, c, d], 1), [3, 3, 2, 4]
    tree = impute.Tree.learn(list("abcd"), sizes, tables_of(data, sizes))
    assert {frozenset(e) for e in tree.edges} == {frozenset((0, 1)), frozenset((1, 2)), frozenset((1, 3))}

    def joint(x):
        return sum(tree.marginal[k][v] for k, v in enumerate(x)) + sum(tree.link[e][x[e[0]], x[e[1]]] for e in tree.edges)

    for target, pattern in ((0, (True, False, False, False)), (0, (True, True, False, False)), (2, (False, True, True, False)), (3, (True, True, True, True))):
        row = np.array([[1, 2, 0, 3]])
        free = [k for k in range(4) if pattern[k] and k != target]
        want = np.zeros(sizes[target])
        for v in range(sizes[target]):
            for rest in np.ndindex(*[sizes[k] for k in free]):
                x = row[0].copy()
                x[target] = v
                x[free] = rest
                want[v] += np.exp(joint(x))
        got = np.exp(tree.posterior(target, row, pattern)[0])
        assert np.allclose(got / got.sum(), want / want.sum(), atol=0.02)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, job string, v double, w double, kind string, c0 string")


def test_group_value_is_found(spark):
    rng = random.Random(4)
    rows = []
    for job in range(60):
        v = rng.randrange(1000)
        for _ in range(5):
            rows.append((len(rows), f"j{job}", None if rng.random() < 0.2 else float(v), float(v // 10), rng.choice("ab"), "clash"))
    value = {}
    for r in rows:
        if r[2] is not None:
            value[r[1]] = r[2]
    got = {r.id: r for r in impute.fill_missing(frame(spark, rows), "id", ["v"], ["w"], ["kind"], {"job": ["v"]}, bins=16, top=4, buckets=4).collect()}
    assert len(got) == len(rows)
    missing = [r for r in rows if r[2] is None and r[1] in value]
    assert all(got[r[0]].v_filled for r in missing) and not any(got[r[0]].v_filled for r in rows if r[2] is not None)
    assert all(got[r[0]].v == r[2] for r in rows if r[2] is not None)
    assert np.mean([got[r[0]].v == value[r[1]] for r in missing]) > 0.9


def test_edges(spark):
    none = frame(spark, [(1, None, None, None, None, None), (2, "j", None, 1.0, "a", None)])
    got = impute.fill_missing(none, "id", ["v"], ["w"], ["kind"], {"job": ["v"]}, bins=4, top=2, buckets=2).collect()
    assert [(r.v, r.v_filled) for r in got] == [(None, False)] * 2
    assert impute.fill_missing(none.limit(0), "id", ["v"], ["w"], ["kind"], {"job": ["v"]}, bins=4, top=2, buckets=2).count() == 0
    same = frame(spark, [(1, "j", 5.0, None, "a", None), (1, "j", 5.0, None, "a", None), (2, None, None, None, "a", None)])
    got = impute.fill_missing(same, "id", ["v"], [], ["kind"], bins=4, top=2, buckets=2).collect()
    assert sorted((r.id, r.v, r.v_filled) for r in got) == [(1, 5.0, False), (1, 5.0, False), (2, 5.0, True)]


def test_groups_by_hand(spark):
    """What others say, with null groups, several names of a group and a value that only the row itself has."""
    rows = [(1, 1, 7, 5.0), (2, 1, 7, 7.0), (3, 1, None, None), (4, 2, 8, 3.0), (5, None, 7, None), (6, None, None, 9.0), (7, None, None, 8.0), (8, 3, None, 4.0)]
    df = spark.createDataFrame(rows, "id bigint, g bigint, h bigint, v double")
    alias = {"h": spark.createDataFrame([(8, 7)], "h bigint, _of bigint")}
    groups = impute.Groups({"g": ["v"], "h": ["v"]}, {"g": ["v"]}, {})
    got = {r.id: (r.least_g_v, r.least_h_v, r.mean_g_v) for r in impute.combined_evidence(df, "id", groups, alias).collect()}
    assert {k: x[:2] for k, x in got.items()} == {1: (7.0, 3.0), 2: (5.0, 3.0), 3: (5.0, None), 4: (None, 3.0), 5: (None, 3.0), 6: (None, None), 7: (None, None), 8: (None, None)}
    mean = np.expm1((np.log(6) + np.log(8)) / 2)
    for small in (0, 100):  # joined by a shuffle, broadcast
        own = {r.id: r.mean_g_v for r in impute.own_evidence(df, "id", impute.Groups({}, {}, {"g": ["v"]}), small).collect()}
        for of in (own, {k: x[2] for k, x in got.items()}):
            assert {k: x is None for k, x in of.items()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True}
            assert of[1] == pytest.approx(7.0, abs=1e-4) and of[3] == pytest.approx(mean, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
def test_held_out_cells(spark):
    """Hides a tenth of the known cells; the filled values must be nearer than the whole table's median, durations nearer than the test's own median."""
    targets = list(problems.FILLED)
    runs = problems.fillable_runs(spark, DIR).persist()
    shown = [F.when(F.pmod(F.xxhash64(F.lit(t), "id"), F.lit(10)) > 0, F.col(t)).alias(t) for t in targets]
    filled = problems.fill_runs(runs.select(*[c for c in runs.columns if c not in targets], *shown), spark.read.parquet(f"{DIR}/commits.parquet"))
    both = filled.select("id", *[F.col(t).alias(f"f_{t}") for t in targets]).join(runs.select("id", "test_id", *targets, *[s.alias(f"s_{t}") for t, s in zip(targets, shown)]), "id").toPandas()
    ratio = {}
    for t in targets:
        cells = both["s_" + t].isna() & both[t].notna()
        truth, got, seen = both[t].astype(float), both[f"f_{t}"].astype(float), both[f"s_{t}"].astype(float)
        if t == "duration_ms":
            truth, got, seen = np.log1p(truth), np.log1p(got), np.log1p(seen)
            own = seen.groupby(both["test_id"]).transform("median").fillna(seen.median())
            ratio["own"] = (truth - own)[cells].abs().mean() / (truth - seen.median())[cells].abs().mean()
        ratio[t] = (truth - got)[cells].abs().mean() / (truth - seen.median())[cells].abs().mean()
        assert got.notna().all() and (both.loc[both["s_" + t].notna(), f"f_{t}"] == both.loc[both["s_" + t].notna(), t]).all()
    assert ratio["timestamp"] < 0.01 and ratio["job_sequence"] < 0.01 and ratio["duration_ms"] < ratio["own"], ratio
