"""How good an order of tests is, and simple ways to order them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.past import percent_ranks, strictly_before
from runloom.session import stored

JOB = ("repo", "job_sequence")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 1 within each job. A job's tests are bounded by its suite."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*JOB).orderBy(*order)))


def mrf_order() -> list[Column]:
    """Most recently failed first, then by name."""
    return [F.col("days_since_last_fail").asc(), F.col("test_id").asc()]


def random_order(seed: int) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), "test_id")).asc(), F.col("test_id").asc()]


def apfd(order: DataFrame) -> DataFrame:
    """(job, tests, faults, apfd) from (job, rank, failed): 1 - sum(ranks of failed) / (n m) + 1 / (2 n); 0 without faults."""
    n, m = F.count("*"), F.sum("failed")
    value = F.when(m > 0, 1 - F.sum(F.col("rank") * F.col("failed")) / (n * m) + 1 / (2 * n)).otherwise(F.lit(0.0))
    return order.groupBy(*JOB).agg(n.alias("tests"), m.alias("faults"), value.alias("apfd"))


def apfdc(order: DataFrame, cost: str = "duration_ms") -> DataFrame:
    """Cost-aware APFD: each failed test is worth the cost from its half on to the end, of all cost, averaged over the faults."""
    to_here = Window.partitionBy(*JOB).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = order.withColumn("_c", F.coalesce(F.col(cost), F.lit(0.0))).withColumn("_done", F.sum("_c").over(to_here))
    total, m = F.sum("_c"), F.sum("failed")
    left = F.sum(F.when(F.col("failed") == 1, F.col("_done") - F.col("_c") / 2).otherwise(0.0))
    return rows.groupBy(*JOB).agg(m.alias("faults"), F.when((m > 0) & (total > 0), 1 - left / (total * m)).otherwise(F.lit(0.0)).alias("apfdc"))


def precision_recall(order: DataFrame, k: int) -> DataFrame:
    """(job, precision, recall) of the first k tests; jobs without a fault are left out."""
    hit = F.sum(F.when(F.col("rank") <= k, F.col("failed")).otherwise(0))
    faults = F.sum("failed")
    out = order.groupBy(*JOB).agg((hit / F.least(F.lit(k), F.count("*"))).alias("precision"), (hit / F.when(faults > 0, faults)).alias("recall"))
    return out.where(F.col("recall").isNotNull())


def failure_matrix(failures: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file_path, test_id, n): in how many failed runs of the test the file had been changed. Combined before the shuffle."""
    return failures.join(files, ["repo", "commit_sha"]).groupBy("repo", "file_path", "test_id").agg(F.count("*").alias("n"))


HOT_SHARE = 1000  # a key with more than this part of all rows is hot: there are fewer than so many
SALTS = 32


def salted(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a further key ``_salt`` that cuts the hot keys of ``many`` into SALTS parts, told by ``by``; their
    rows of ``few`` are repeated once per part. What the hot keys of a task join to is then a SALTS-th of the whole."""
    counts = stored(many.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > total / HOT_SHARE).select(*keys, F.lit(True).alias("_hot")))  # fewer than HOT_SHARE rows
    left = many.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0)).drop("_hot")
    zero = F.lit(0).cast("bigint")
    parts = F.when(F.col("_hot"), F.sequence(zero, zero + SALTS - 1)).otherwise(F.array(zero))
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left, right


def matrix_scores(current: DataFrame, files: DataFrame, matrix: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(repo, commit_sha, test_id, score) for the distinct (repo, commit_sha, test_id) of ``current``: the sum of the matrix over the
    commit's files; with ``changes`` (repo, file_path, changed) each entry is divided by how often the file was changed."""
    weight = F.col("n").cast("double")
    if changes is not None:
        matrix = matrix.join(changes, ["repo", "file_path"])
        weight = weight / F.col("changed")
    changed = files.join(current.select("repo", "commit_sha").distinct(), ["repo", "commit_sha"], "left_semi")
    left, right = salted(changed, matrix, ["repo", "file_path"], "commit_sha")
    by_commit = left.join(right, ["repo", "file_path", "_salt"])
    scores = by_commit.groupBy("repo", "commit_sha", "test_id").agg(F.sum(weight).alias("score"))
    tests = current.select("repo", "commit_sha", "test_id").distinct()
    return tests.join(scores, ["repo", "commit_sha", "test_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation, null where either side does not vary."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 1e-9) & (sb > 1e-9), F.try_divide(F.covar_pop(a, b), sa * sb))


def stopped(order: DataFrame, score: str, thresholds: tuple[float, ...]) -> DataFrame:
    """``order`` once per threshold, with ``_run``: whether the test runs before its job stops. A job stops at the first test where the running
    share of its score passes the threshold."""
    by = Window.partitionBy(*JOB).orderBy("rank")
    so_far = F.coalesce(F.sum(score).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = order.withColumn("_before", F.round(F.try_divide(so_far, F.sum(score).over(Window.partitionBy(*JOB))), 9))
    return rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("_run", F.coalesce(F.col("_before") <= F.col("threshold"), F.lit(True)))


def early_exit(order: DataFrame, score: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, tests, share_run, fault_miss_rate): what jobs that stop early run, and the share of faults among what they skip."""
    rows = stopped(order, score, thresholds)
    missed = F.sum(F.when(~F.col("_run"), F.col("failed")).otherwise(0))
    return rows.groupBy("threshold").agg(F.count("*").alias("tests"), F.avg(F.col("_run").cast("double")).alias("share_run"), F.try_divide(missed.cast("double"), F.sum("failed")).alias("fault_miss_rate"))


def time_saved(order: DataFrame, score: str, thresholds: tuple[float, ...], cost: str = "duration_ms") -> DataFrame:
    """(threshold, total_ms, saved_ms, saved_share): the time of the tests that jobs skip when they stop as in ``early_exit``."""
    rows = stopped(order, score, thresholds).withColumn("_c", F.coalesce(F.col(cost), F.lit(0.0)))
    total, saved = F.sum("_c"), F.sum(F.when(~F.col("_run"), F.col("_c")).otherwise(0.0))
    return rows.groupBy("threshold").agg(total.alias("total_ms"), saved.alias("saved_ms"), F.coalesce(F.try_divide(saved, total), F.lit(0.0)).alias("saved_share"))


def flaky_scores(history: DataFrame, least_runs: int = 20) -> DataFrame:
    """(repo, test_id, runs, score, flagged): percent rank of the mean duration variance times one minus the correlation of the 7-day
    and 30-day failure rates; flagged above 0.7 with a 30-day rate between 0.05 and 0.5.

    The percent rank is over the tests of a repo with enough runs; one row a test, aggregated from all its runs. Tests whose
    rates do not vary have no correlation and count as 0.
    """
    tests = history.groupBy("repo", "test_id").agg(
        F.count("*").alias("runs"),
        F.round(F.avg("duration_variance"), 6).alias("variance"),
        F.coalesce(correlation(F.col("failure_rate_7d"), F.col("failure_rate_30d")), F.lit(0.0)).alias("agreement"),
        F.avg("failure_rate_30d").alias("rate"),
    )
    tests = tests.where(F.col("runs") >= least_runs)
    score = F.col("pct") * (1 - F.col("agreement"))
    return percent_ranks(stored(tests, "tests"), "repo", "variance").select("repo", "test_id", "runs", score.alias("score"), ((score > 0.7) & (F.col("rate") > 0.05) & (F.col("rate") < 0.5)).alias("flagged"))


def psi(expected: DataFrame, actual: DataFrame, columns: tuple[str, ...], bins: int = 10, least: float = 1e-4) -> DataFrame:
    """(feature, psi): the population stability index over equal-width bins of the expected range; empty bins count as ``least``."""
    span = expected.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns]).first()
    pair = lambda df, side: df.select(
        F.lit(side).alias("side"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _bin(c, span[f"lo_{c}"], span[f"hi_{c}"], bins).alias("bin")) for c in columns])).alias("x"),
    )
    counts = pair(expected, "e").unionByName(pair(actual, "a")).where(F.col("x.bin").isNotNull()).groupBy("x.feature", "x.bin").agg(F.count_if(F.col("side") == "e").alias("e"), F.count_if(F.col("side") == "a").alias("a"))
    totals = counts.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share = counts.join(totals, "feature").select("feature", F.greatest(F.try_divide(F.col("e").cast("double"), F.col("te")), F.lit(least)).alias("e"), F.greatest(F.try_divide(F.col("a").cast("double"), F.col("ta")), F.lit(least)).alias("a"))
    return share.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


DRIFTED = 0.2  # a mean index above it


def drift_verdict(indices: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(features, mean_psi, drifted): the mean index of ``features`` (those that matter most), and whether it passes DRIFTED."""
    got = indices.where(F.col("feature").isin(*features)).agg(F.count("psi").alias("features"), F.avg("psi").alias("mean_psi"))
    return got.withColumn("drifted", F.coalesce(F.col("mean_psi") > DRIFTED, F.lit(False)))


def _bin(c: str, lo: float | None, hi: float | None, bins: int) -> Column:
    v = F.col(c).cast("double")
    inside = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins) if lo is not None and hi > lo else F.lit(0)
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), inside)))


def ema_priority(runs: DataFrame, alpha: float = 0.8) -> DataFrame:
    """(repo, test_id, priority): P = alpha F + (1 - alpha) P over all of a test's runs in order, from 0.

    Runs are range-partitioned by test and job; each part of a test's history gives its own sum and length, and a part counts
    (1 - alpha) to the number of runs after it: a test of any size lies in as many tasks as it needs.
    """
    keys, fade = ["repo", "test_id"], F.lit(float(1 - alpha))
    rows = stored(runs.select(*keys, "job_sequence", "failed").repartitionByRange(*keys, "job_sequence").withColumn("_part", F.spark_partition_id()), "ranged")
    age = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(F.desc("job_sequence"))) - 1
    value = F.sum(F.col("failed") * F.lit(alpha) * F.pow(fade, F.col("_age")))
    parts = rows.withColumn("_age", age).groupBy("_part", *keys).agg(value.alias("_sum"), F.count("*").alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    return whole.groupBy(*keys).agg(F.sum(F.col("_sum") * F.pow(fade, F.col("_later"))).alias("priority"))


def bootstrap_interval(values: DataFrame, column: str, key: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, low, high): the mean and its 2.5 and 97.5 percentiles over Poisson resamples, with weights told by hash of key and resample."""
    draws = values.select(column, key).withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))))  # -1: the values themselves
    u = F.pmod(F.xxhash64(F.lit(seed), "b", key), F.lit(1_000_000)) / 1_000_000.0
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = F.when(F.col("b") < 0, 1).otherwise(sum(((u >= s).cast("int") for s in steps), F.lit(0)))
    means = draws.groupBy("b").agg(F.try_divide(F.sum(F.col(column) * weight), F.sum(weight)).alias("m"))
    of = F.when(F.col("b") >= 0, F.col("m"))
    low, high = F.percentile(of, F.lit(0.025)), F.percentile(of, F.lit(0.975))
    return means.agg(F.max(F.when(F.col("b") < 0, F.col("m"))).alias("mean"), low.alias("low"), high.alias("high"))


def paired_difference(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, wilcoxon_z, cohens_d) of paired values: signed-rank statistic with average ranks for ties, and the mean difference in deviations.

    For measures between 0 and 1. Ranks come from the counts of each distinct absolute difference, in at most 1001 blocks,
    not from a sort of all rows in one task.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where(F.col("d").isNotNull())
    spread = d.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).first()
    effect = spread["mean"] / spread["sd"] if spread["sd"] else None
    sizes = d.where("d <> 0").groupBy(F.round(F.abs("d"), 9).alias("x")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("pos"))
    block = F.floor(F.col("x") * 1000)
    sizes = sizes.withColumn("block", block)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("bn")).withColumn("offset", F.coalesce(F.sum("bn").over(before), F.lit(0)))
    inside = Window.partitionBy("block").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks.select("block", "offset"), "block")
    rank = F.col("offset") + F.col("_in") + (F.col("n") + 1) / 2
    w = ranks.agg(F.sum("n").alias("n"), F.sum(rank * F.col("pos")).alias("w"))
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0)
    return w.select("n", z.alias("wilcoxon_z"), F.lit(effect).cast("double").alias("cohens_d"))


def label_correlation(df: DataFrame, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """(feature, correlation): the absolute correlation of each feature with the label, one pass."""
    got = df.agg(*[F.abs(correlation(F.col(f).cast("double"), F.col(label).cast("double"))).alias(f) for f in features])
    return got.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features])).alias("x")).select("x.*")


def mutual_information(df: DataFrame, features: tuple[str, ...], label: str = "label", bins: int = 10) -> DataFrame:
    """(feature, information) in nats between each feature, cut at its deciles, and the label; from contingency counts over all rows."""
    return information(contingency(df, features, label, bins))


def contingency(df: DataFrame, features: tuple[str, ...], label: str = "label", bins: int = 10) -> DataFrame:
    """(feature, x, y, n): how many rows with the label y lie in cell x of each feature, cut at its deciles.

    The columns are stored, as they are read twice: first for the deciles, then for the counts.
    """
    df = stored(df.select(F.col(label).alias("y"), *[F.col(f).cast("double").alias(f) for f in features]), "columns", tidy=True)
    points = [k / bins for k in range(1, bins)]
    cuts = df.agg(*[F.percentile_approx(f, points, 10000).alias(f) for f in features]).first()
    cell = lambda f: sum(((F.col(f) > F.lit(c)).cast("int") for c in sorted(set(cuts[f] or []))), F.lit(0))
    long = df.select("y", F.posexplode(F.array(*map(cell, features))).alias("f", "x"))
    counts = long.groupBy("f", "x", "y").agg(F.count("*").alias("n"))
    return counts.select(F.get(F.array(*map(F.lit, features)), F.col("f")).alias("feature"), "x", "y", "n")


def cut_counts(counts: DataFrame, bins: int = 10) -> DataFrame:
    """``contingency`` from (feature, value, n, failed), the rows of each value and the failed ones among them: the label is 0 or 1, the
    deciles are exact. The rows below a value tell its cell: as many deciles lie below it."""
    counts = stored(counts, "values")
    placed = strictly_before(counts, ["feature"], "value", {"_below": F.col("n")}, distinct=True)
    rows = placed.join(F.broadcast(counts.groupBy("feature").agg(F.sum("n").alias("_all"))), "feature")
    cell = F.least(F.expr(f"(_below * {bins}) div _all"), F.lit(bins - 1)).cast("int")
    cells = rows.groupBy("feature", cell.alias("x")).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
    labels = F.array(F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("failed")).alias("n")), F.struct(F.lit(1).alias("y"), F.col("failed").alias("n")))
    return cells.select("feature", "x", F.explode(labels).alias("c")).select("feature", "x", "c.y", "c.n").where("n > 0")


def information(counts: DataFrame) -> DataFrame:
    """(feature, information) in nats from the counts of ``contingency``."""
    of = Window.partitionBy("feature")
    rows = counts.select("feature", "n", F.sum("n").over(of).alias("t"), F.sum("n").over(Window.partitionBy("feature", "x")).alias("nx"), F.sum("n").over(Window.partitionBy("feature", "y")).alias("ny"))
    return rows.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))).alias("information"))


def completed(counts: DataFrame, total: tuple[int, int], defaults: Mapping[str, float]) -> DataFrame:
    """(feature, value, n, failed) from ``counts`` of some rows: the others, of ``total`` rows and failed ones, have the feature's default."""
    of = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("value")) for f, v in defaults.items()])
    whole = counts.sparkSession.range(1).select(F.explode(of).alias("x")).select("x.*", F.lit(total[0]).cast("bigint").alias("n"), F.lit(total[1]).cast("bigint").alias("failed"))
    found = counts.select("feature", F.lit(None).cast("double").alias("value"), (-F.col("n")).alias("n"), (-F.col("failed")).alias("failed"))
    rest = whole.unionByName(found).groupBy("feature").agg(F.max("value").alias("value"), F.sum("n").alias("n"), F.sum("failed").alias("failed"))
    return counts.unionByName(rest).groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).where("n > 0")
