import pytest
from pyspark.sql import functions as F

from runloom.operators import evaluate, ingest, matrix, quality, split
from tests.conftest import T0, rows

S = [f"{k:040x}" for k in range(1, 9)]


@pytest.fixture(scope="module")
def small(spark, make_runs, make_commits):
    runs = make_runs([{"job_id": str(100 + j), "test_id": f"p.T{t}", "commit_sha": S[j] if j < 3 else None, "timestamp": T0 + j * 1000 if j < 3 else None, "outcome": "FAIL" if (j, t) == (1, 0) else "PASS"} for j in range(4) for t in range(2)])
    commits = make_commits([{"commit_sha": S[j], "committed_ts": T0 + j * 1000} for j in range(3)])
    files = spark.createDataFrame([("a@b", S[0], "src/test/java/p/T0.java", None), ("a@b", S[1], "src/main/java/p/X.java", None)], "repo string, commit_sha string, file_path string, loaded_at timestamp_ntz")
    return matrix.feature_matrix(ingest.sequenced_runs(runs), ingest.commit_rows(commits), ingest.changed_files(files))


def test_matrix(small):
    assert small.columns == list(matrix.COLUMNS) and len(small.columns) == 38 and small.count() == 8
    quality.validate_features(small)
    quality.require_no_nulls(small)
    without = small.where("commit_sha is null").collect()
    assert len(without) == 2 and all(r.commit_meta_missing == 1 and r.feature_source == "job_sequence" and r.author_failure_rate_90d == -1.0 for r in without)


def test_order_of_input_and_the_future_change_nothing(spark, make_runs):
    from runloom.operators.history import test_history as history_of

    data = [{"id": k, "job_id": str(k), "timestamp": T0 + k * 50, "outcome": "FAIL" if k % 3 else "PASS"} for k in range(1, 12)]
    a = rows(history_of(ingest.sequenced_runs(make_runs(data[:8]))))
    b = [r for r in rows(history_of(ingest.sequenced_runs(make_runs(data[::-1])))) if r[0] <= 8]
    assert a == b


def test_gates(small):
    with pytest.raises(AssertionError, match="no rows"):
        quality.validate_features(small.limit(0))
    with pytest.raises(AssertionError, match="lacks label"):
        quality.validate_features(small.drop("label"))
    with pytest.raises(AssertionError, match="too many nulls"):
        quality.validate_features(small.withColumn("run_count_30d", F.lit(None).cast("bigint")))
    with pytest.raises(AssertionError, match="label"):
        quality.validate_features(small.withColumn("label", F.lit(2)))
    with pytest.raises(AssertionError, match="unknown source"):
        quality.validate_features(small.withColumn("feature_source", F.lit("x")))
    with pytest.raises(AssertionError, match="baselines"):
        quality.validate_features(small, {"a@b": (90.0, "absolute", 0.5)})
    quality.validate_features(small, {"a@b": (25.0, "absolute", 0.5)})
    with pytest.raises(ValueError):
        quality.require_no_nulls(small.withColumn("label", F.lit(None).cast("int")))
    assert rows(quality.null_profile(small).where("nulls > 0"), "column", "nulls") == [("commit_sha", 2), ("timestamp", 2)]
    assert quality.monotonic(small).where("not ok").count() == 0
    falling = small.withColumn("timestamp", F.when(F.col("job_sequence") == 1, F.col("timestamp") + 10**6).otherwise(F.col("timestamp")))
    assert quality.monotonic(falling).where("not ok").count() == 2
    with pytest.raises(AssertionError, match="fall from one job"):
        quality.validate_features(falling)
    quality.validate_features(falling, in_order=False)


def test_coverage_and_selection(spark):
    got = quality.coverage_gate(spark.createDataFrame([("a", 70.0, 70.0), ("b", 100.0, 69.9), ("c", 0.0, 80.0)], "repo string, sha_pct double, row_pct double"))
    assert rows(got, "repo", "ok") == [("a", True), ("b", False), ("c", False)]
    marked = [("b", 0.5, "SELECTED"), ("A", 0.5, "SELECTED"), ("c", 0.7, "SELECTED"), ("d", 0.9, "REJECTED")]
    df = spark.createDataFrame(marked, "repo string, rate double, status string")
    assert quality.require_selected(df) == ["c", "A", "b"]
    with pytest.raises(ValueError, match="2 of at least 3"):
        quality.require_selected(df.where("repo <> 'c'"))


def test_order_and_known_means(small):
    got = matrix.in_order(small).collect()
    assert [r.timestamp is None for r in got] == sorted(r.timestamp is None for r in got) or got[0].timestamp is None  # a day per job lies before real times
    keys = [(r.timestamp if r.timestamp is not None else r.job_sequence * 86400, r.job_sequence, r.commit_sha or "~", r.test_id) for r in got]
    assert keys == sorted(keys)
    profile = quality.repo_profile(small).first()
    assert (profile.rows, profile.failures, profile.failure_rate, profile.by_sequence_pct, profile.meta_missing_pct) == (8, 1, 0.125, 25.0, 25.0)
    days = [r.days_since_last_fail for r in small.collect() if r.days_since_last_fail != 999.0]
    m = {r.feature: r for r in matrix.known_means(small).collect()}["days_since_last_fail"]
    assert m.known == len(days) and m.mean == (pytest.approx(sum(days) / len(days)) if days else None)


def jobs(spark, n, repo="a"):
    return spark.createDataFrame([(repo, k, None if k in (3, 7) else "s", t) for k in range(1, n + 1) for t in ("x", "y")], "repo string, job_sequence bigint, commit_sha string, test_id string")


def test_temporal_split(spark):
    train, test = split.temporal_split(jobs(spark, 10))
    assert {r[0] for r in train.select("job_sequence").collect()} == set(range(1, 9)) and {r[0] for r in test.select("job_sequence").collect()} == {9, 10}
    train, test = split.temporal_split(jobs(spark, 2))
    assert train.count() == test.count() == 2
    train, test = split.temporal_split(jobs(spark, 17))
    assert not train.select("job_sequence").intersect(test.select("job_sequence")).count()
    with pytest.raises(ValueError, match="one repo"):
        split.temporal_split(jobs(spark, 2).union(jobs(spark, 2, "b")))
    with pytest.raises(ValueError, match="missing"):
        split.temporal_split(jobs(spark, 2).drop("repo"))
    assert split.split_sides(jobs(spark, 5).withColumn("job_sequence", F.when(F.col("job_sequence") < 5, F.col("job_sequence")))).where("side is null").count() == 2


def test_folds(spark):
    got = rows(split.time_folds(jobs(spark, 6).select("repo", "job_sequence").distinct(), 2), "job_sequence", "fold")
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2)]


def order(spark, data):
    return spark.createDataFrame([("r", 1, k, f, c) for k, (f, c) in enumerate(data, 1)], "repo string, job_sequence bigint, rank int, failed int, duration_ms double")


def test_measures(spark):
    o = order(spark, [(1, 1.0), (0, 1.0), (1, 2.0), (0, None), (0, 4.0)])
    assert evaluate.apfd(o).first().apfd == pytest.approx(0.7)
    assert evaluate.apfd(order(spark, [(0, 1.0)])).first().apfd == 0.0
    assert evaluate.apfdc(o).first().apfdc == pytest.approx(1 - (0.5 + 3.0) / (8 * 2))
    r = evaluate.precision_recall(o, 2).first()
    assert (r.precision, r.recall) == (0.5, 0.5)
    assert evaluate.precision_recall(order(spark, [(0, 1.0)]), 2).count() == 0


def test_matrix_scores(spark):
    fails = spark.createDataFrame([("r", "c1", "t"), ("r", "c2", "t"), ("r", "c2", "u")], "repo string, commit_sha string, test_id string")
    files = spark.createDataFrame([("r", "c1", "f"), ("r", "c2", "f"), ("r", "c3", "f"), ("r", "c3", "g")], "repo string, commit_sha string, file_path string")
    m = evaluate.failure_matrix(fails, files)
    now = spark.createDataFrame([("r", "c3", t) for t in "tuv"], "repo string, commit_sha string, test_id string")
    assert rows(evaluate.matrix_scores(now, files, m), "test_id", "score") == [("t", 2.0), ("u", 1.0), ("v", 0.0)]
    changes = spark.createDataFrame([("r", "f", 2)], "repo string, file_path string, changed int")
    assert rows(evaluate.matrix_scores(now, files, m, changes), "test_id", "score") == [("t", 1.0), ("u", 0.5), ("v", 0.0)]


def test_salted_join_loses_nothing(spark):
    """Keys with a third of all rows, and rare ones, join as without salts."""
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("k"), F.col("id").alias("c"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, v int")
    left, right = evaluate.salted(many, few, ["k"], "c")
    assert left.where("k = 'hot'").select("_salt").distinct().count() == evaluate.SALTS and left.count() == 3000
    assert rows(left.join(right, ["k", "_salt"]), "k", "c", "v") == rows(many.join(few, "k"), "k", "c", "v")


def test_ema(spark):
    runs = spark.createDataFrame([("r", "t", k, f) for k, f in enumerate([1, 0, 1])], "repo string, test_id string, job_sequence bigint, failed int")
    p = 0.0
    for f in (1, 0, 1):
        p = 0.8 * f + 0.2 * p
    assert evaluate.ema_priority(runs).first().priority == pytest.approx(p)
    many = spark.range(1, 301).select(F.lit("r").alias("repo"), (F.col("id") % 2).cast("string").alias("test_id"), F.col("id").alias("job_sequence"), (F.col("id") % 7 != 3).cast("int").alias("failed"))
    for alpha in (0.05, 0.8, 1.0):
        want = {"0": 0.0, "1": 0.0}
        for k in range(1, 301):
            want[str(k % 2)] = alpha * (k % 7 != 3) + (1 - alpha) * want[str(k % 2)]
        assert {r.test_id: r.priority for r in evaluate.ema_priority(many, alpha).collect()} == pytest.approx(want)


def test_paired(spark):
    pairs = [(0.9, 0.1), (0.8, 0.2), (0.3, 0.5), (0.5, 0.5), (0.7, 0.1)]
    r = evaluate.paired_difference(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()
    # absolute differences 0.8 0.6 0.2 0.6: ranks 4 2.5 1 2.5, positive sum 9
    assert r.n == 4 and r.wilcoxon_z == pytest.approx((9 - 5) / (4 * 5 * 9 / 24) ** 0.5)


def test_psi_and_information(spark):
    a = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    assert evaluate.psi(a, a, ("x",)).first().psi == pytest.approx(0.0)
    assert evaluate.psi(a, a.where("x < 3"), ("x",)).first().psi > 1
    assert evaluate.mutual_information(a, ("x",)).first().information == pytest.approx(0.693, abs=0.01)
    assert evaluate.label_correlation(a.withColumn("c", F.lit(1)), ("x", "c")).where("feature = 'c'").first().correlation is None


def test_early_exit(spark):
    df = order(spark, [(1, 1.0), (0, 1.0), (1, 1.0)]).withColumn("score", F.when(F.col("rank") == 1, 0.9).otherwise(0.05))
    got = {r.threshold: r for r in evaluate.early_exit(df, "score", (0.7, 0.95)).collect()}
    assert got[0.7].fault_miss_rate == 0.5 and got[0.95].fault_miss_rate == 0.0
    saved = {r.threshold: (r.total_ms, r.saved_ms) for r in evaluate.time_saved(df, "score", (0.7, 0.95)).collect()}
    assert saved == {0.7: (3.0, 2.0), 0.95: (3.0, 0.0)}


def test_drift_verdict(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 9.0)], "feature string, psi double")
    assert tuple(evaluate.drift_verdict(df, ("a", "b")).first()) == (2, pytest.approx(0.3), True)
    assert evaluate.drift_verdict(df, ("b",)).first().drifted is False and evaluate.drift_verdict(df, ()).first().drifted is False


def test_run_checks_writes_once_and_unites(spark, make_runs, make_commits, tmp_path):
    from runloom.plans import pipeline

    tables = tmp_path / "tables"
    data = [{"repo": r, "job_id": str(j * 2 + k), "test_id": f"p.T{t}", "timestamp": T0 + j, "commit_sha": S[j % 4]} for k, r in enumerate(["a@b", "c@d"]) for j in range(1, 8) for t in range(3)]
    make_runs(data).write.parquet(str(tables / "test_runs.parquet"))
    make_commits([{"repo": r, "commit_sha": s} for r in ("a@b", "c@d") for s in S[:4]]).write.parquet(str(tables / "commits.parquet"))
    spark.createDataFrame([("a@b", S[0], "x/A.java", None)], "repo string, commit_sha string, file_path string, loaded_at timestamp_ntz").write.parquet(str(tables / "file_changes.parquet"))
    for repo in ("a@b", "c@d"):
        assert rows(pipeline.run(spark, str(tables), str(tmp_path / "out"), repo)) == [(repo, 0, 21)]
    assert pipeline.run(spark, str(tables), str(tmp_path / "out"), "a@b") is None
    assert pipeline.run(spark, str(tables), str(tmp_path / "out"), "a@b", force=True, coverage=70.0) is not None
    with pytest.raises(ValueError, match="a@b: 100.0% of the commits"):
        pipeline.run(spark, str(tables), str(tmp_path / "out"), "a@b", force=True, coverage=100.5)
    full = pipeline.assemble(spark, [str(tmp_path / f"out/{r}_features.parquet") for r in ("a@b", "c@d")], str(tmp_path / "full"))
    assert full.count() == 42 and spark.read.parquet(str(tmp_path / "full")).columns == list(matrix.COLUMNS)
    assert rows(pipeline.sample(full.select("test_id").distinct(), 2, "test_id")) == rows(pipeline.sample(full.select("test_id").distinct(), 2, "test_id"))


def test_learned_order_beats_chance(spark):
    from runloom.operators import models

    df = spark.range(4000).select(
        F.lit("r").alias("repo"),
        (F.col("id") / 20).cast("bigint").alias("job_sequence"),
        F.concat(F.lit("t"), F.col("id") % 20).alias("test_id"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("x"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.lit(1)).alias("y"),
    )
    df = df.withColumn("label", (F.col("x") > 0.93).cast("int"))
    got = models.held_out_apfd(df.where("job_sequence < 150"), df.where("job_sequence >= 150"), ("x", "y")).first()
    assert got.learned > 0.9 and got.random < 0.7
    model = models.train(df, ("x", "y"), kind="boosted", trees=3)
    assert models.importances(model, ("x", "y"))[0][0] == "x"
