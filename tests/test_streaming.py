from runloom.streaming import collector
from tests.conftest import T0, rows

LINE = "line_id bigint, file_name string, line_no int, raw_line string"


def lines(spark, data):
    return spark.createDataFrame([(k, "a@b.csv", k, text) for k, text in data], LINE)


def test_collector_adds_nothing_twice(spark, tmp_path):
    source, out, bad, state = (str(tmp_path / x) for x in ("in", "out", "bad", "state"))

    def take():
        stream = spark.readStream.schema(LINE).parquet(source)
        collector.collect_results(stream, out, bad, state).awaitTermination()

    lines(spark, [(1, "1,a.T,0,0.5,2,0,0,0"), (2, "oops")]).write.parquet(source)
    take()
    lines(spark, [(3, "1,a.T,0,0.9,2,1,0,0"), (4, "2,a.T,0,0.9,2,1,0,0"), (2, "oops")]).write.mode("append").parquet(source)
    take()
    take()
    assert rows(spark.read.parquet(out), "job_id", "outcome") == [(1, "PASS"), (2, "FAIL")]
    assert rows(spark.read.parquet(bad)) == [(2, "columns", "a@b")]
    other = spark.createDataFrame([("a@b",)], "repo string")
    assert collector.taken(spark, out, other, "repo") is not None and collector.taken(spark, str(tmp_path / "none"), other, "repo") is None


def test_daily_counts_and_streaks(spark, make_runs, tmp_path):
    path = str(tmp_path / "runs")
    data = [{"timestamp": T0 + k * 40000, "outcome": "FAIL" if k == 2 else "PASS", "test_id": "t"} for k in range(6)] + [{"timestamp": None, "test_id": "u"}]
    make_runs(data).repartition(3).write.parquet(path)
    stream = collector.stream_table(spark, path, 1)
    days = {}
    for r in data[:6]:
        d = r["timestamp"] // 86400
        n, f = days.get(d, (0, 0))
        days[d] = (n + 1, f + (r["outcome"] == "FAIL"))
    assert rows(collector.latest(collector.daily_counts(stream), "days"), "day_no", "runs", "failed") == sorted((d, n, f) for d, (n, f) in days.items())
    found = []
    query = collector.live_streaks(collector.stream_table(spark, path)).writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.test_id, r.runs, r.streak) for r in found} == {("t", 6, 3), ("u", 1, 1)}


def test_late_rows_count_by_id(spark, make_runs, tmp_path):
    """Batches in any order end with the streak that the ids give."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    data = [{"id": k, "job_id": str(k), "test_id": f"t{k % 3}", "outcome": "FAIL" if rng.random() < 0.1 else "PASS"} for k in range(1, 121)]
    want = {}
    for r in data:
        n, streak = want.get(r["test_id"], (0, 0))
        want[r["test_id"]] = (n + 1, 0 if r["outcome"] == "FAIL" else streak + 1)
    path = str(tmp_path / "runs")
    for part in range(4):
        make_runs([r for r in rng.sample(data, len(data)) if r["id"] * 7 % 4 == part]).write.mode("append").parquet(path)
    last = {}
    stream = collector.live_streaks(collector.stream_table(spark, path, 1))
    keep = lambda b, n: last.update({r.test_id: (r.runs, r.streak) for r in b.collect()})
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert last == want
    counts = spark.createDataFrame([("a", 10, 10, 1), ("a", 12, 10, 5), ("b", 12, 10, 5), ("c", 11, 10, 1), ("c", 13, 10, 1)], "repo string, day_no bigint, runs bigint, failed bigint")
    assert rows(collector.drifted(counts, 12).select("repo", "before", "after", F.col("drifted"))) == [("a", 0.1, 0.5, True), ("b", None, 0.5, False), ("c", 0.1, 0.1, False)]
