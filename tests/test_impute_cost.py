"""What p5 works out once instead of for every row, and that it stays the same."""

import re

import numpy as np

from runloom.operators import impute
from runloom.plans import problems
from tests.test_impute import tables_of


def test_combinations_are_met_by_one_number(spark):
    """The join of the rows with their combinations sorts by one number, and rows of equal hashes but other nulls stay apart."""
    rows = [(1, 5, None, 1.0), (2, None, 5, 2.0), (3, 5, None, 3.0), (4, None, 5, 4.0), (5, None, None, 9.0), (6, 5, 5, None)]
    df = spark.createDataFrame(rows, "id bigint, g bigint, h bigint, v double")
    out = impute.combined_evidence(df, "id", impute.Groups({"g": ["v"], "h": ["v"]}, {}, {}), {})
    got = {r.id: (r.least_g_v, r.least_h_v) for r in out.collect()}
    assert got == {1: (3.0, None), 2: (None, 4.0), 3: (1.0, None), 4: (None, 2.0), 5: (None, None), 6: (1.0, 2.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, \(_cell#\d+L = _cell#\d+L\)", plan), plan


def test_posterior_once_for_equal_rows(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [4, 5, 3, 6]
    a = rng.integers(0, 4, 3000)
    data = np.stack([a, (a + rng.integers(0, 2, 3000)) % 5, a % 3, np.where(rng.random(3000) < 0.6, a, 5)], 1)
    tree = impute.Tree.learn(list("abcd"), sizes, tables_of(data, sizes))
    worked, whole = [], impute.Tree.posterior
    monkeypatch.setattr(impute.Tree, "posterior", lambda self, t, codes, p: (worked.append(len(codes)), whole(self, t, codes, p))[1])
    for pattern in np.ndindex(2, 2, 2, 2):
        pattern = tuple(map(bool, pattern))
        for t in range(4):
            if pattern[t]:
                codes = np.where(pattern, -1, data)
                assert (tree.decoded(t, codes, pattern) == impute.middle(whole(tree, t, codes, pattern))).all()
                assert tree.decoded(t, codes[:0], pattern).shape == (0,)
    assert max(worked) <= 4 * 5 * 3 * 6


def test_contingency_by_hand(spark, monkeypatch):
    """All rows that have both fields count, in slices of any length; a category of few values gets no room for others."""
    monkeypatch.setattr(impute, "SLICE", 3)
    rng = np.random.default_rng(3)
    rows = [(k, *[None if rng.random() < 0.3 else float(rng.integers(0, 9)) for _ in range(2)], None if k % 4 == 0 else k % 3) for k in range(50)]
    coding = impute.Coding(["v", "w"], [[2.0, 5.0], [4.0]], ["c"])
    sizes = [3, 2, 3]
    want = {(a, b): np.zeros((sizes[a], sizes[b])) for a in range(3) for b in range(a + 1, 3)}
    for _, v, w, c in rows:
        code = [None if v is None else int(v >= 2) + int(v >= 5), None if w is None else int(w >= 4), c]
        for (a, b), table in want.items():
            if code[a] is not None and code[b] is not None:
                table[code[a], code[b]] += 1
    got = impute.contingency(spark.createDataFrame(rows, "id bigint, v double, w double, c int"), coding, sizes)
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    values, many = impute.frequent(spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "c string"), "c", 512)
    assert many == 2 and values.count() == 2


def test_forms_of_a_commit(spark, make_runs, tmp_path):
    """One sha in any form is one commit; short references go by repo and text, and zeros name nothing."""
    sha = "ab12cd34" * 5
    forms = [sha, sha.upper(), f" {sha}\t", f"{sha.upper()}\n", sha[:9], sha[:9].upper() + " ", "0" * 40, "g" * 40, "", None, " " * 40, sha + "0", sha[:6]]
    make_runs([{"commit_sha": x} for x in forms]).write.parquet(f"{tmp_path}/test_runs.parquet")
    got = {r.id: (None if r.commit is None else bytes(r.commit), r.short) for r in problems.fillable_runs(spark, str(tmp_path)).collect()}
    whole, short = (bytes.fromhex(sha), None), (f"a@b|{sha[:9]}".encode(), f"a@b|{sha[:9]}")
    assert [got[k] for k in range(1, len(forms) + 1)] == [whole] * 4 + [short] * 2 + [(None, None)] * 7
