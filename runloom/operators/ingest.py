"""Test runs, commits and changed files in normal form, and the order of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.keys import DAY_S, failed, is_sha, job_number, reference, trimmed, usable_duration, usable_timestamp
from runloom.session import stored


def first_rows(test_runs: DataFrame, *fields: str) -> DataFrame:
    """One row per job number and test, the one with the least id; rows without either are left out.

    With ``fields`` only these (and job_id, test_id, id, repo) are taken along: the rows are shuffled whole.

    commit_sha is the full sha in lower case or null, outcome in upper case, duration_ms and timestamp null where
    absent; ``failed`` is 1 for FAIL and ERROR.
    """
    ref = reference()
    columns = {
        "commit_sha": F.when(is_sha(ref), ref),
        "test_index": F.col("test_index"),
        "outcome": F.upper(trimmed("outcome")),
        "duration_ms": usable_duration().cast("double"),
        "timestamp": usable_timestamp(),
        "run_count": F.col("run_count"),
        "failed": failed().cast("int"),
    }
    row = F.struct("id", "repo", *[c.alias(n) for n, c in columns.items() if not fields or n in fields])
    rows = test_runs.select(job_number().alias("job_id"), "test_id", row.alias("r")).where(F.col("job_id").isNotNull() & F.col("test_id").isNotNull())
    return rows.repartition("job_id", "test_id").groupBy("job_id", "test_id").agg(F.min("r").alias("r")).select("job_id", "test_id", "r.*")


def jobs_of(test_runs: DataFrame) -> DataFrame:
    """Distinct (repo, job_id) of the rows that count as runs; rows of a job are combined before the shuffle."""
    return test_runs.where(F.col("test_id").isNotNull()).select("repo", job_number().alias("job_id")).where(F.col("job_id").isNotNull()).distinct()


def ranked_jobs(runs: DataFrame) -> DataFrame:
    """(repo, job_id, job_sequence): the rank of each job within its repo by its number.

    Distinct jobs are sorted over range partitions and numbered there; the counts of the partitions before give the
    offset. A repo with a third of all jobs is spread over many tasks.
    """
    jobs = runs.select("repo", "job_id").where(F.col("repo").isNotNull()).distinct()
    jobs = stored(jobs.repartitionByRange("repo", "job_id").withColumn("part", F.spark_partition_id()), "jobs")
    before = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = jobs.groupBy("repo", "part").agg(F.count("*").alias("n")).select("repo", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("repo", "part").orderBy("job_id"))
    return jobs.withColumn("place", place).join(offsets, ["repo", "part"]).select("repo", "job_id", (F.col("offset") + F.col("place")).alias("job_sequence"))


def sequenced_runs(test_runs: DataFrame, *fields: str) -> DataFrame:
    """``first_rows`` with job_sequence and the effective time ``ets``: the timestamp, else a day per job."""
    runs = first_rows(test_runs, *fields, *(["timestamp"] if fields else []))
    jobs = ranked_jobs(jobs_of(test_runs))
    return runs.join(jobs, ["repo", "job_id"]).withColumn("ets", F.coalesce("timestamp", F.col("job_sequence") * DAY_S))


def commit_rows(commits: DataFrame) -> DataFrame:
    """One row per repo and sha, the one loaded last; e-mails in lower case."""
    columns = ["author_email", "message", "parent_count", "authored_at", "utc_offset_min", "committed_ts"]
    rows = commits.withColumn("author_email", F.nullif(F.lower(trimmed("author_email")), F.lit(""))).select("repo", reference().alias("commit_sha"), F.struct("loaded_at", *columns).alias("r"))
    rows = rows.where(is_sha(F.col("commit_sha")) & F.col("repo").isNotNull())
    return rows.groupBy("repo", "commit_sha").agg(F.max("r").alias("r")).select("repo", "commit_sha", *[f"r.{c}" for c in columns])


def changed_files(file_changes: DataFrame) -> DataFrame:
    """Distinct (repo, commit_sha, file_path) with full shas and normalised paths."""
    ref = reference()
    rows = file_changes.select("repo", F.when(is_sha(ref), ref).alias("commit_sha"), normal_path("file_path").alias("file_path"))
    return rows.where(F.col("commit_sha").isNotNull() & (F.col("file_path") != "") & F.col("repo").isNotNull()).distinct()


def normal_path(c: str):
    """Slashes for back-slashes, no white space around, no leading run of dots and slashes."""
    return F.ltrim(F.regexp_replace(trimmed(c), r"\\", "/"), F.lit("./"))


def last_mapping(test_runs: DataFrame) -> DataFrame:
    """(job_id, commit_sha): of a job's references that are shas the last loaded one."""
    ref = reference()
    rows = test_runs.select(job_number().alias("job_id"), ref.alias("ref"), "id").where(F.col("job_id").isNotNull() & is_sha(F.col("ref")))
    return rows.groupBy("job_id").agg(F.max_by("ref", "id").alias("commit_sha"))


def derived_outcome(failures: str = "failures", errors: str = "errors", skipped: str = "skipped", count: str = "run_count"):
    """FAIL if anything failed, SKIPPED if all of at least one was skipped, else PASS; blanks count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return F.when((n(failures) > 0) | (n(errors) > 0), "FAIL").when((n(skipped) > 0) & (n(skipped) == n(count)), "SKIPPED").otherwise("PASS")


def ingest_results(loaded: DataFrame, mapping: DataFrame) -> DataFrame:
    """Loaded CSV lines to runs: outcome derived, first line of a job and test wins, the job's commit attached."""
    row = F.struct("line_id", F.regexp_replace("file_name", r"\.csv$", "").alias("repo"), "test_index", derived_outcome().alias("outcome"), "duration_ms", F.coalesce("run_count", F.lit(0)).alias("run_count"))
    first = loaded.select("job_id", "test_id", row.alias("r")).groupBy("job_id", "test_id").agg(F.min("r").alias("r")).select("job_id", "test_id", "r.*")
    return first.join(mapping, "job_id", "left")


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of which ``existing`` has no key: what an insert that ignores conflicts adds."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends to the table at ``path`` the rows it has no key of; how many these were."""
    spark = rows.sparkSession
    new = stored(insert_new(spark.read.schema(rows.schema).parquet(path), rows, keys), "new")
    new.write.mode("append").parquet(path)
    return new.count()


def merged_times(runs: DataFrame, commits: DataFrame) -> DataFrame:
    """``runs`` with ``ts``, the timestamp or else that of the commit, and ``resolved``, whether ``commits`` has the commit."""
    times = commits.select("repo", "commit_sha", "committed_ts", F.lit(True).alias("resolved"))
    return runs.join(times, ["repo", "commit_sha"], "left").withColumn("ts", F.coalesce("timestamp", "committed_ts")).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def time_coverage(merged: DataFrame) -> DataFrame:
    """(repo, shas, resolved_shas, eligible, timestamped, sha_pct, row_pct) for each repo of ``merged_times``; a repo without commits has zeros.

    Rows are counted per commit first: a repo of any size comes together as one row per commit.
    """
    rows = merged.groupBy("repo", "commit_sha").agg(F.count("*").alias("n"), F.count("ts").alias("t"), F.max("resolved").alias("resolved"))
    has = F.col("commit_sha").isNotNull()
    total = lambda c: F.sum(F.when(has, F.col(c)).otherwise(0))
    per = rows.groupBy("repo").agg(F.count_if(has).alias("shas"), F.count_if(has & F.col("resolved")).alias("resolved_shas"), total("n").alias("eligible"), total("t").alias("timestamped"))
    pct = lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    return per.withColumn("sha_pct", pct("resolved_shas", "shas")).withColumn("row_pct", pct("timestamped", "eligible"))
