"""What other rows of the same test and commit say reaches cells of tests beyond the most frequent ones."""

import random

import numpy as np

from runloom.plans import problems
from tests.conftest import T0


def test_rare_tests_and_commits(spark, make_runs, make_commits, tmp_path):
    rng = random.Random(3)
    longest = [float(np.exp(rng.uniform(2, 14))) for _ in range(900)]  # each test has its own duration
    rows, truth = [], {}
    for job in range(60):
        sha = f"{job // 2 + 1:02x}" * 20  # two jobs of each commit, loaded together
        for test in range(job % 4, 900, 4):
            hidden = rng.random() < 0.1
            truth[len(rows) + 1] = longest[test] if hidden else None, test
            lone = job == 31  # a whole job without times
            rows.append({"job_id": str(job + 1), "commit_sha": sha if job % 5 else sha[:12], "test_id": f"t{test}", "duration_ms": None if hidden else longest[test], "timestamp": None if lone else T0 + 5000 * (job // 2), "job_sequence": None if lone else 100 + job // 2})
    make_runs(rows).write.parquet(f"{tmp_path}/test_runs.parquet")
    make_commits([{"commit_sha": f"{k + 1:02x}" * 20} for k in range(30)]).write.parquet(f"{tmp_path}/commits.parquet")
    got = {r.id: r for r in problems.filled_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    off = [abs(np.log(got[k].duration_ms) - np.log(v)) for k, (v, _) in truth.items() if v is not None]
    assert np.mean(off) < 0.3  # their spread is 3.0
    alone = [got[k] for k in truth if rows[k - 1]["job_id"] == "32"]
    assert {(r.timestamp, r.job_sequence) for r in alone} == {(T0 + 5000 * 15, 115)} and all(r.timestamp_filled for r in alone)
