"""Commit and author features, computed once per commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.keys import DAY_S
from runloom.operators.past import before_each, strictly_before
from runloom.session import stored

# Words that make a commit message risky.
RISK_KEYWORDS = ["fix", "hotfix", "bug", "patch", "revert", "urgent", "crash", "error", "broken", "regression"]
AUTHOR_DAYS = 90
AUTHOR = ["repo", "author_email"]
HOT_COMMITS = 1_000_000  # commits of one author in one repo from which on they are cut over tasks
LEAST_COMMITS = 3
COMMIT_COLUMNS = ("files_changed_total", "java_files_changed", "source_files_changed", "test_files_changed", "lines_added", "lines_deleted", "churn_total", "is_merge_commit", "commit_hour", "commit_day_of_week", "keyword_risk_score", "commit_meta_missing", "commit_diff_missing")
AUTHOR_COLUMNS = ("author_commit_count_90d", "author_failure_rate_90d", "author_feature_fallback", "feature_source")


def keyword_score(message: Column) -> Column:
    """How many of the risk words the message has as whole words."""
    text = F.coalesce(F.lower(message), F.lit(""))
    return sum((text.rlike(rf"(?<![a-z0-9_]){w}(?![a-z0-9_])").cast("int") for w in RISK_KEYWORDS), F.lit(0))


def file_counts(files: DataFrame) -> DataFrame:
    """Changed files per commit: all, Java, Java sources, Java tests."""
    path = F.lower("file_path")
    java = path.endswith(".java")
    test = java & (path.contains("/test/") | path.startswith("test/"))
    counts = files.groupBy("repo", "commit_sha").agg(F.count("*").alias("files_changed_total"), F.count_if(java).alias("java_files_changed"), F.count_if(test).alias("test_files_changed"))
    return counts.withColumn("source_files_changed", F.col("java_files_changed") - F.col("test_files_changed"))


def diff_lines(diff: Column) -> tuple[Column, Column]:
    """Added and deleted lines of a unified diff, headers not counted."""
    lines = F.split(diff, "\n")
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    deleted = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return added, deleted


def numstat_lines(numstat: DataFrame) -> DataFrame:
    """Lines added and deleted against the first parent; binary files (``-``) do not count."""
    rows = numstat.where("parent_no = 1").select("repo", "commit_sha", F.expr("try_cast(added as bigint)").alias("a"), F.expr("try_cast(deleted as bigint)").alias("d"))
    return rows.groupBy("repo", "commit_sha").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("d"), F.lit(0)).alias("lines_deleted"))


def commit_features(keys: DataFrame, commits: DataFrame, files: DataFrame, numstat: DataFrame | None = None) -> DataFrame:
    """The thirteen commit columns for each (repo, commit_sha) of ``keys``.

    A commit without metadata has zeros and both missing flags; without line counts it has zeros and
    commit_diff_missing, but a root commit counts as an empty diff.
    """
    local = F.expr("authored_at + make_dt_interval(0, 0, coalesce(utc_offset_min, 0), 0)")
    out = keys.join(file_counts(files), ["repo", "commit_sha"], "left")
    meta = commits.select(
        "repo",
        "commit_sha",
        (F.col("parent_count") > 1).cast("int").alias("is_merge_commit"),
        F.hour(local).alias("commit_hour"),
        F.weekday(local).alias("commit_day_of_week"),
        keyword_score(F.col("message")).alias("keyword_risk_score"),
        (F.col("parent_count") == 0).alias("is_root"),
        F.lit(True).alias("has_meta"),
    )
    out = out.join(meta, ["repo", "commit_sha"], "left")
    if numstat is None:
        lines = [F.lit(0).alias("lines_added"), F.lit(0).alias("lines_deleted"), F.lit(0).alias("churn_total")]
        missing = F.when(F.col("has_meta") & F.col("is_root"), 0).otherwise(1)
    else:
        out = out.join(numstat_lines(numstat), ["repo", "commit_sha"], "left")
        known = F.coalesce("has_meta", F.lit(False))
        n = lambda c: F.when(known, F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
        lines = [n("lines_added").alias("lines_added"), n("lines_deleted").alias("lines_deleted"), (n("lines_added") + n("lines_deleted")).alias("churn_total")]
        missing = F.when(known & (F.col("is_root") | F.col("lines_added").isNotNull()), 0).otherwise(1)
    counts = ["files_changed_total", "java_files_changed", "source_files_changed", "test_files_changed"]
    meta_columns = ["is_merge_commit", "commit_hour", "commit_day_of_week", "keyword_risk_score"]
    return out.select(
        "repo",
        "commit_sha",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        *lines,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in meta_columns],
        F.when(F.col("has_meta"), 0).otherwise(1).alias("commit_meta_missing"),
        missing.alias("commit_diff_missing"),
    )


def tested_commits(runs: DataFrame) -> DataFrame:
    """(repo, commit_sha, failed, first_seq, first_fail_seq, n, fails) of each commit with runs; n and fails count its runs."""
    fail = F.col("failed") == 1
    return runs.where(F.col("commit_sha").isNotNull()).groupBy("repo", "commit_sha").agg(F.max("failed").alias("failed"), F.min("job_sequence").alias("first_seq"), F.min(F.when(fail, F.col("job_sequence"))).alias("first_fail_seq"), F.count("*").alias("n"), F.count_if(fail).alias("fails"))


def with_authors(tested: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, commit_sha, author_email, ts, failed, first_seq, first_fail_seq) of the ``tested_commits`` that have an author."""
    tested = tested.select("repo", "commit_sha", "failed", "first_seq", "first_fail_seq")
    return tested.join(commits.select("repo", "commit_sha", "author_email", F.col("committed_ts").alias("ts")), ["repo", "commit_sha"]).where(F.col("author_email").isNotNull())


def author_commits(runs: DataFrame, commits: DataFrame) -> DataFrame:
    """``with_authors`` of each commit that was tested."""
    return with_authors(tested_commits(runs), commits)


def _rated(count: Column, fails: Column) -> list[Column]:
    return [count.alias("author_commit_count_90d"), F.when(count < LEAST_COMMITS, F.lit(-1.0)).otherwise(fails / count).alias("author_failure_rate_90d")]


def _hot_apart(authored: DataFrame, hot_commits: int) -> tuple[DataFrame, DataFrame | None]:
    """The commits of ordinary authors, and those of authors with too many for one task, if there are any."""
    authored = stored(authored, "authored")
    hot = authored.groupBy(*AUTHOR).count().where(F.col("count") > hot_commits).select(*AUTHOR)
    if not hot.limit(1).count():
        return authored, None
    return authored.join(hot, AUTHOR, "left_anti"), authored.join(hot, AUTHOR, "left_semi")


def author_by_time(authored: DataFrame, hot_commits: int = HOT_COMMITS) -> DataFrame:
    """For commits with a time: the author's commits of the 90 days before it and the share that failed, -1 below three."""
    span, fail = AUTHOR_DAYS * DAY_S, F.col("failed")
    cold, hot = _hot_apart(authored.where(F.col("ts").isNotNull()), hot_commits)
    key = Window.partitionBy(*AUTHOR).orderBy("ts")
    prior, older = key.rangeBetween(Window.unboundedPreceding, -1), key.rangeBetween(Window.unboundedPreceding, -span - 1)
    zero = F.lit(0)
    rows = cold.withColumn("_n", F.count("*").over(prior) - F.count("*").over(older)).withColumn("_f", F.coalesce(F.sum(fail).over(prior), zero) - F.coalesce(F.sum(fail).over(older), zero))
    rows = rows.select("repo", "commit_sha", "_n", "_f")
    if hot is not None:
        counted = strictly_before(hot, AUTHOR, "ts", {"_n": F.lit(1), "_f": fail}).withColumn("_since", F.col("ts") - span)
        past = before_each(counted.select(*AUTHOR, F.col("_since").alias("ts")), hot, AUTHOR, "ts", {"_no": F.lit(1), "_fo": fail}).withColumnRenamed("ts", "_since")
        counted = counted.join(past, [*AUTHOR, "_since"])
        rows = rows.unionByName(counted.select("repo", "commit_sha", (F.col("_n") - F.col("_no")).alias("_n"), (F.col("_f") - F.col("_fo")).alias("_f")))
    return rows.select("repo", "commit_sha", *_rated(F.col("_n"), F.col("_f")), F.lit(0).alias("author_feature_fallback"), F.lit("timestamp").alias("feature_source"))


def author_by_sequence(authored: DataFrame, hot_commits: int = HOT_COMMITS) -> DataFrame:
    """The same without times, over all jobs before the commit's first: a commit counts from its first job on, as failed from
    its first failing job on. Both are events on the sequence axis, summed up before each commit."""
    at = authored.where(F.col("first_seq").isNotNull())
    commits = at.select(*AUTHOR, "commit_sha", F.col("first_seq").alias("seq"), F.lit(1).alias("c"), F.lit(0).alias("f"))
    fails = at.where(F.col("first_fail_seq").isNotNull()).select(*AUTHOR, F.lit(None).cast("string").alias("commit_sha"), F.col("first_fail_seq").alias("seq"), F.lit(0).alias("c"), F.lit(1).alias("f"))
    cold, hot = _hot_apart(commits.unionByName(fails), hot_commits)
    prior = Window.partitionBy(*AUTHOR).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    rows = cold.withColumn("_n", F.coalesce(F.sum("c").over(prior), F.lit(0))).withColumn("_f", F.coalesce(F.sum("f").over(prior), F.lit(0)))
    if hot is not None:
        rows = rows.unionByName(strictly_before(hot, AUTHOR, "seq", {"_n": F.col("c"), "_f": F.col("f")}))
    return rows.where(F.col("c") == 1).select("repo", "commit_sha", *_rated(F.col("_n"), F.col("_f")), F.lit(1).alias("author_feature_fallback"), F.lit("job_sequence").alias("feature_source"))


def author_features(keys: DataFrame, authored: DataFrame) -> DataFrame:
    """The four author columns for each (repo, commit_sha) of ``keys``: by time where the commit has one, else by sequence."""
    found = author_by_time(authored).unionByName(author_by_sequence(authored.join(authored.where(F.col("ts").isNotNull()).select("repo", "commit_sha"), ["repo", "commit_sha"], "left_anti")))
    default = {"author_commit_count_90d": F.lit(0), "author_failure_rate_90d": F.lit(-1.0), "author_feature_fallback": F.lit(1), "feature_source": F.lit("job_sequence")}
    return keys.join(found, ["repo", "commit_sha"], "left").select("repo", "commit_sha", *[F.coalesce(c, d).alias(c) for c, d in default.items()])
