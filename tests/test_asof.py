import random

from runloom.operators import asof
from tests.conftest import T0, at, rows

OWNERS = "version_id bigint, repo string, test_id string, owner_team string, tier string, quarantined boolean, timeout_s int, valid_from timestamp_ntz, known_at timestamp_ntz"
ATTRIBUTES = ("owner_team", "tier", "quarantined", "timeout_s", "version_id")


def test_brute_force(spark, make_runs, make_commits):
    rng = random.Random(5)
    versions = []
    for v in range(300):
        valid = T0 + rng.randrange(0, 200 * 86400) + rng.choice([0, 0.5])
        known = rng.choice([None, valid, valid + rng.randrange(-50, 50) * 86400])
        if rng.random() < 0.3 and versions:
            valid = versions[-1][8 - 1] or valid
        versions.append([v, "a@b", f"t{rng.randrange(4)}", rng.choice(["p", "q", None]), rng.choice("gs"), rng.choice([True, False, None]), rng.randrange(3), valid, known])
    versions.append([999, "a@b", "t0", "never", None, None, 1, None, T0])
    ts = lambda x: None if x is None else at(x)
    frame = spark.createDataFrame([(*v[:7], ts(v[7]), ts(v[8])) for v in versions], OWNERS)
    shared = frame.limit(0).drop("repo")
    data = [{"test_id": f"t{rng.randrange(5)}", "timestamp": T0 + rng.randrange(-10**6, 260 * 86400), "loaded_at": at(T0 + 400 * 86400)} for _ in range(400)]
    got = {r.id: r for r in asof.run_attributes(make_runs(data), make_commits([]), frame, shared, ATTRIBUTES).collect()}
    assert len(got) == len(data)
    for k, r in enumerate(data, 1):
        ok = [v for v in versions if v[2] == r["test_id"] and v[7] is not None and v[7] <= r["timestamp"] and (v[8] if v[8] is not None else v[7]) <= r["timestamp"]]
        best = max(ok, key=lambda v: (v[7], v[8] if v[8] is not None else v[7], v[0]), default=None)
        assert tuple(got[k][a] for a in ATTRIBUTES) == ((best[3], best[4], best[5], best[6], best[0]) if best else (None,) * 5)


def test_event_time(spark, make_runs, make_commits):
    sha = "c0ffee" + "0" * 34
    runs = make_runs([{"timestamp": T0}, {"timestamp": None, "commit_sha": sha.upper()}, {"timestamp": -1, "commit_sha": "c0ffee0"}, {"timestamp": None}, {"timestamp": None, "commit_sha": sha, "repo": "z"}])
    commits = make_commits([{"commit_sha": sha, "committed_ts": 5, "deleted_at": at(T0)}, {"commit_sha": sha, "committed_ts": 7}])
    assert rows(asof.event_times(runs, commits), "id", "t") == [(1, T0), (2, 5), (3, 5)]


def test_shared_tests_and_empty_tables(spark, make_runs, make_commits):
    none = spark.createDataFrame([], OWNERS)
    shared = spark.createDataFrame([(1, "x.T", "s", "g", None, 3, at(T0 - 5), None)], OWNERS.replace("repo string, ", ""))
    runs = make_runs([{"repo": "p"}, {"repo": None}, {"test_id": "other"}])
    got = rows(asof.run_attributes(runs, make_commits([]), none, shared, ("version_id",)), "id", "version_id")
    assert got == [(1, 1), (2, 1), (3, None)]
    assert asof.run_attributes(runs.limit(0), make_commits([]), none, shared, ("version_id",)).count() == 0
