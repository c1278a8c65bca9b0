import random

from runloom.operators import orphans
from tests.conftest import T0, at, rows

A, B = "a1" * 20, "a1b2" * 10


def found(runs, commits):
    return rows(orphans.orphan_rows(orphans.orphan_references(orphans.demand(orphans.references(runs, "test_runs")), commits)), "id")


def test_cases(make_runs, make_commits):
    commits = make_commits([
        {"commit_sha": f" {A.upper()}\t", "loaded_at": at(T0), "deleted_at": at(T0 + 100)},
        {"commit_sha": A, "loaded_at": at(T0 + 200)},
        {"commit_sha": A, "loaded_at": at(T0 + 200)},
        {"commit_sha": B, "repo": "other"},
        {"commit_sha": None},
    ])
    runs = make_runs([
        {"commit_sha": A, "loaded_at": at(T0)},  # visible
        {"commit_sha": A, "loaded_at": at(T0 - 1)},  # too early
        {"commit_sha": A, "loaded_at": at(T0 + 100)},  # deleted
        {"commit_sha": f"{A[:7].upper()} ", "loaded_at": at(T0 + 300)},  # short, came back
        {"commit_sha": A[:6], "loaded_at": at(T0 + 300)},  # too short
        {"commit_sha": B, "loaded_at": at(T0 + 300)},  # another repo's
        {"commit_sha": "HEAD"},
        {"commit_sha": " \t"},
        {"commit_sha": None},
        {"commit_sha": "0" * 40},
        {"commit_sha": A, "repo": None},
        {"commit_sha": A, "loaded_at": None},
    ])
    assert found(runs, commits) == [(k,) for k in (10, 11, 12, 2, 3, 5, 6, 7)]


def test_empty(make_runs, make_commits):
    assert found(make_runs([{"commit_sha": A}]), make_commits([])) == [(1,)]
    assert found(make_runs([]), make_commits([{"commit_sha": A}])) == []


def test_heavy_keys_take_the_same_verdict(make_runs, make_commits):
    rng = random.Random(3)
    shas = [f"{k:040x}" for k in range(1, 40)]
    commits = make_commits([{"commit_sha": s, "loaded_at": at(T0 + rng.randrange(50)), "deleted_at": rng.choice([None, at(T0 + 70)])} for s in shas[:30]])
    data = [{"commit_sha": shas[0] if k % 3 else rng.choice(shas), "loaded_at": at(T0 + rng.randrange(100))} for k in range(4000)]
    seen = {r.commit_sha: r for r in commits.collect()}
    want = [k for k, r in enumerate(data, 1) if not ((c := seen.get(r["commit_sha"])) and c.loaded_at <= r["loaded_at"] and (c.deleted_at is None or c.deleted_at > r["loaded_at"]))]
    runs = make_runs(data)
    assert sorted(x[0] for x in found(runs, commits)) == want
    refs = orphans.demand(orphans.references(runs, "test_runs"))
    report = orphans.orphan_report(refs, orphans.orphan_references(refs, commits))
    assert sum(r.orphans for r in report.collect()) == len(want) and sum(r.refs for r in report.collect()) == 4000
