import random
from collections import Counter

import numpy as np
import pytest

from runloom.llm import splits
from tests.conftest import rows

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def components(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(("j", a), set()).add(("s", b))
        near.setdefault(("s", b), set()).add(("j", a))
    seen, out = set(), []
    for x in near:
        if x not in seen:
            todo, got = [x], set()
            while todo:
                y = todo.pop()
                if y not in got:
                    got.add(y)
                    todo += near[y]
            seen |= got
            out.append(sorted(v for k, v in got if k == "j"))
    return {j: c[0] for c in out for j in c if len(c) > 1}


def labels_of(spark, pairs, **kw):
    df = spark.createDataFrame([(a, str(b).encode()) for a, b in pairs], "job bigint, sha binary").repartition(6)
    return {r.node: r.root for r in splits.groups(splits.linked(df, **kw)).collect()}


def test_roots():
    assert splits.roots(np.array([1, 3, 4]), np.array([2, 4, 0]), 6).tolist() == [0, 1, 1, 0, 0, 5]


@pytest.mark.parametrize("task_links", [splits.TASK_LINKS, 20])
def test_groups_against_search(spark, task_links):
    """With few links to a task the forests are contracted in rounds instead of merged in one."""
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(330)) for _ in range(420)] + [(1000 + k, 5000 + k // 2) for k in range(60)] + [(1001 + k, 5000 + k // 2) for k in range(60)]
    assert labels_of(spark, pairs, task_links=task_links) == components(pairs)


def test_one_commit_of_a_third_of_all_jobs(spark):
    pairs = [(k, 0 if k % 3 == 0 else k) for k in range(900)] * 2
    got = labels_of(spark, pairs)
    assert len(got) == 300 and set(got.values()) == {0}


def test_no_links(spark):
    assert labels_of(spark, [(1, 2), (3, 4)]) == {} and labels_of(spark, []) == {}


def test_named_commits(spark, make_runs, make_commits):
    a, b = "ab" * 20, "abc1" * 10
    runs = make_runs([{"job_id": "1", "commit_sha": a.upper()}, {"job_id": " 02.0", "commit_sha": f"{a}\n"}, {"job_id": "3", "commit_sha": a[:7]}, {"job_id": "4", "commit_sha": a[:7], "repo": "z"}, {"job_id": "5", "commit_sha": b}, {"job_id": None, "commit_sha": a}, {"job_id": "6", "commit_sha": "0" * 40}, {"job_id": "7", "commit_sha": None}])
    got = splits.named_commits(splits.numbered_jobs(runs), make_commits([{"commit_sha": a}]))
    assert sorted((r.job, bytes(r.sha).hex()) for r in got.collect()) == [(1, a), (2, a), (3, a), (5, b)]
    assert rows(splits.group_pairs(splits.linked(got))) == [(1, 2), (1, 3), (2, 3)]


def greedy(sizes, shares):
    short, got = [s * sum(a * b for a, b in sizes) for s in shares], []
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            k = max(range(len(short)), key=lambda i: (round(short[i], 6), -i))
            short[k] -= size
            got.append((size, k))
    return Counter(got), short


def test_allot_is_the_greedy_rule():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [(s, rng.randrange(1, 40)) for s in rng.sample(range(1, 60), rng.randrange(1, 9))]
        want, short = greedy(sizes, SHARES.values())
        plan = splits.allot(sizes, list(SHARES.values()))
        assert {s: sum(g) for s, g in plan} == dict(sizes)
        left = [share * sum(a * b for a, b in sizes) - sum(s * g[k] for s, g in plan) for k, share in enumerate(SHARES.values())]
        assert max(map(abs, left)) <= max(map(abs, short)) + max(s for s, _ in sizes) + 1e-6


def test_assignment(spark, make_runs):
    rng = random.Random(8)
    data = [{"job_id": str(j), "test_id": f"t{t}"} for j in range(300) for t in range(rng.randrange(1, 9))] + [{"job_id": "x", "job_sequence": 5}] * 2 + [{"job_id": None, "job_sequence": None}] * 2
    runs = make_runs(data)
    labels = spark.createDataFrame([(k, k // 4 * 4) for k in range(100) if k % 4], "node bigint, root bigint")
    jobs = splits.all_jobs(runs)
    got = splits.assign_splits(jobs, labels, SHARES).collect()
    assert sum(r.rows for r in got) == len(data) and len({r.job for r in got}) == len(got) == 303
    of = {}
    for r in got:
        assert of.setdefault(r.group_id, r.split) == r.split
    share = Counter()
    for r in got:
        share[r.split] += r.rows / len(data)
    assert all(abs(share[k] - v) < 0.03 for k, v in SHARES.items())
    assert splits.assign_splits(jobs.limit(0), labels, SHARES).count() == 0


def test_rows_without_a_job_number(make_runs, make_commits):
    """Such a row belongs to the numbered job of its repo and sequence and ties it to others by the commit it names."""
    sha = "cd" * 20
    runs = make_runs([
        {"job_id": "7", "job_sequence": 3}, {"job_id": "8", "job_sequence": 3}, {"job_id": "?", "job_sequence": 3, "commit_sha": sha},
        {"job_id": "9", "job_sequence": 4, "commit_sha": sha}, {"job_id": None, "job_sequence": 3, "repo": "z"}, {"job_id": None, "job_sequence": 3, "repo": "z", "commit_sha": sha},
        {"job_id": "", "job_sequence": None}, {"job_id": "", "job_sequence": 3, "repo": None},
    ])
    jobs = splits.all_jobs(runs)
    got = Counter(r.job for r in jobs.collect())
    assert {k: n for k, n in got.items() if k > 0} == {7: 2, 8: 1, 9: 1} and sorted(n for k, n in got.items() if k < 0) == [1, 1, 2]
    group = {frozenset((r.node, r.root)) for r in splits.linked(splits.named_commits(jobs, make_commits([]))).collect()}
    other = next(k for k, n in got.items() if n == 2 and k < 0)
    assert group == {frozenset((other, 7)), frozenset((other, 9))}
