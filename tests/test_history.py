import random

import pytest

from runloom.operators.history import COLUMNS, HOT_RUNS, test_history as history_of
from tests.conftest import T0

DAY = 86400
COLD = (-1, -1.0, -1.0, -1.0, 999.0, 999.0, 0, 0.0, 0.0, 0)


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(k, "r", *r) for k, r in enumerate(rows)], "id bigint, repo string, test_id string, ets bigint, job_sequence bigint, failed int, duration_ms double")

    return make


def last(df):
    return dict(zip(COLUMNS, max(history_of(df).collect(), key=lambda r: r.id)[1:]))


def run(ets, failed=0, ms=10.0, seq=None):
    return ("t", ets, seq if seq is not None else ets, failed, ms)


def test_cold_start(frame):
    assert tuple(last(frame([run(T0)])).values()) == COLD


def test_two_failures(frame):
    h = last(frame([run(100, 1), run(200, 1), run(300)]))
    assert (h["last_outcome"], h["consecutive_passes"], h["failure_rate_30d"]) == (1, 0, 1.0)


def test_passes_only(frame):
    h = last(frame([run(100), run(200), run(300), run(400)]))
    assert (h["last_outcome"], h["consecutive_passes"], h["days_since_last_fail"], h["failure_rate_30d"]) == (0, 3, 999.0, 0.0)


def test_one_of_three(frame):
    h = last(frame([run(T0 - 3 * DAY), run(T0 - 2 * DAY, 1), run(T0 - DAY), run(T0)]))
    assert h["failure_rate_30d"] == pytest.approx(1 / 3) and h["last_outcome"] == 0 and h["consecutive_passes"] == 1
    assert h["days_since_last_fail"] == 2.0 and h["days_since_last_run"] == 1.0


def test_same_time_is_not_before(frame):
    assert tuple(last(frame([run(T0, 1, seq=1), run(T0, seq=2)])).values()) == COLD


def test_lower_bound_is_inside(frame):
    assert last(frame([run(T0 - 90 * DAY - 1, 1), run(T0 - 90 * DAY), run(T0 - 1, 1), run(T0)]))["failure_rate_90d"] == 0.5


def test_durations(frame):
    h = last(frame([run(1, ms=42.0), run(2)]))
    assert (h["avg_duration_ms"], h["duration_variance"]) == (42.0, 0.0)
    h = last(frame([run(k, ms=float(k)) for k in range(1, 23)] + [run(99)]))
    assert h["avg_duration_ms"] == 12.5 and h["duration_variance"] == pytest.approx(33.25)


def test_count_30d(frame):
    assert last(frame([run(T0 - 31 * DAY), run(T0 - 30 * DAY), run(T0 - 1), run(T0)]))["run_count_30d"] == 2


def test_no_time_at_all(frame):
    with pytest.raises(Exception, match="neither a timestamp"):
        history_of(frame([("t", None, 1, 0, 1.0)])).collect()


@pytest.mark.parametrize("hot_runs", [HOT_RUNS, 60])
def test_against_brute_force(frame, hot_runs):
    """With few runs to a hot test, the histories are cut over tasks."""
    rng = random.Random(9)
    data = [(f"t{rng.choice([0, 0, 0, 0, 1, 2])}", T0 + rng.randrange(60) * 40000, k, int(rng.random() < 0.3), rng.choice([None, 1.0, 5.0, 7.0])) for k in range(300)]
    rng.shuffle(data)
    got = {r.id: r for r in history_of(frame(data), hot_runs=hot_runs).collect()}
    for k, (t, ets, _, _, _) in enumerate(data):
        prior = sorted((r for r in data if r[0] == t and r[1] < ets), key=lambda r: (r[1], r[2]))
        if not prior:
            assert tuple(got[k][c] for c in COLUMNS) == COLD
            continue
        streak = 0
        for r in reversed(prior):
            if r[3]:
                break
            streak += 1
        ms = [r[4] for r in prior[-20:] if r[4] is not None]
        mean = sum(ms) / len(ms) if ms else 0.0
        fails = [r[1] for r in prior if r[3]]
        want = {"last_outcome": prior[-1][3], "consecutive_passes": streak, "days_since_last_fail": (ets - max(fails)) / DAY if fails else 999.0, "days_since_last_run": (ets - prior[-1][1]) / DAY, "avg_duration_ms": mean, "duration_variance": sum((x - mean) ** 2 for x in ms) / len(ms) if len(ms) > 1 else 0.0}
        for d in (7, 30, 90):
            inside = [r[3] for r in prior if r[1] >= ets - d * DAY]
            want[f"failure_rate_{d}d"] = sum(inside) / len(inside) if inside else -1.0
        want["run_count_30d"] = len([r for r in prior if r[1] >= ets - 30 * DAY])
        assert {c: got[k][c] for c in COLUMNS} == pytest.approx(want)


def test_one_exchange(frame):
    plan = history_of(frame([run(1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
