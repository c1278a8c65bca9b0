"""Queries of the test-history pipeline, each over its whole tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.sql import BLANK, FAILED, JOB, REF, USABLE_MS, USABLE_TS
from runloom.operators import commits as C
from runloom.operators import dependency, evaluate, history, ingest, matrix, models, quality, split
from runloom.operators.ingest import changed_files, commit_rows, sequenced_runs
from runloom.operators.past import exact_percentiles
from runloom.plans import pipeline
from runloom.plans.problems import SQL_LINES
from runloom.session import stored
from runloom.sources.csv_rejects import load_results
from runloom.sources.tables import table
from runloom.streaming import collector

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def runs_of(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return sequenced_runs(table(spark, d, "test_runs"), *fields)


def timed_runs(spark: SparkSession, d: str) -> DataFrame:
    """What the history columns need of the runs."""
    return runs_of(spark, d, "duration_ms", "failed")


def commits_of(spark: SparkSession, d: str) -> DataFrame:
    return commit_rows(table(spark, d, "commits"))


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return changed_files(table(spark, d, "file_changes"))


SHA = f"case when regexp_full_match({REF}, '[0-9a-f]{{40}}') and {REF} <> repeat('0', 40) then {REF} end"
CTE_RUNS = f"""first_ as (
  select job job_id, test_id, arg_min(struct_pack(id := id, repo := repo, commit_sha := sha, test_index := test_index, outcome := o, duration_ms := ms, ts := ts, run_count := run_count, f := f), id) r
  from (select *, {JOB} job, {SHA} sha, upper(trim(outcome, {BLANK})) o, cast({USABLE_MS} as double) ms, {USABLE_TS} ts, cast({FAILED} as int) f from test_runs)
  where job is not null and test_id is not null group by 1, 2),
runs_ as (select job_id, test_id, r.id id, r.repo repo, r.commit_sha commit_sha, r.test_index test_index, r.outcome outcome, r.duration_ms duration_ms, r.ts "timestamp", r.run_count run_count, r.f failed,
  dense_rank() over (partition by r.repo order by job_id) job_sequence from first_),
runs as (select *, coalesce("timestamp", job_sequence * 86400) ets from runs_)"""
CTE_COMMITS = f"""commit_ as (select repo, sha commit_sha, author_email, message, parent_count, authored_at, utc_offset_min, committed_ts from (
  select *, row_number() over (partition by repo, sha order by loaded_at desc nulls last, email desc nulls last, message desc nulls last, parent_count desc nulls last, authored_at desc nulls last, utc_offset_min desc nulls last, committed_ts desc nulls last) k from (
    select repo, {SHA} sha, nullif(lower(trim(author_email, {BLANK})), '') email, nullif(lower(trim(author_email, {BLANK})), '') author_email, message, parent_count, authored_at, utc_offset_min, committed_ts, loaded_at from commits) where sha is not null) where k = 1)"""
PATH = rf"ltrim(replace(trim(file_path, {BLANK}), '\', '/'), './')"
CTE_FILES = f"""files as (select distinct repo, {SHA} commit_sha, {PATH} file_path from file_changes where {SHA} is not null and {PATH} <> '' and repo is not null)"""


def sql_corr(a: str, b: str) -> str:
    return f"case when stddev_pop({a}) > 1e-9 and stddev_pop({b}) > 1e-9 then covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# Ingestion


@query(
    SQL_LINES
    + f""", loaded as (select l.line_id, regexp_replace(r.file_name, '\\.csv$', '') repo, cast(f[1] as bigint) job_id, f[2] test_id, cast(nullif(f[3], '') as bigint) test_index, 1000 * cast(nullif(f[4], '') as double) duration_ms,
    coalesce(cast(nullif(f[5], '') as bigint), 0) run_count, coalesce(cast(nullif(f[6], '') as bigint), 0) failures, coalesce(cast(nullif(f[7], '') as bigint), 0) errors, coalesce(cast(nullif(f[8], '') as bigint), 0) skipped
    from lines l join raw_results r using (line_id) where reason is null),
  firsts as (select *, row_number() over (partition by job_id, test_id order by line_id) k from loaded),
  mapping as (select job job_id, arg_max(ref, id) commit_sha from (select {JOB} job, {SHA} ref, id from test_runs) where job is not null and ref is not null group by 1)
  select line_id, repo, job_id, test_id, test_index, round(duration_ms, 6) duration_ms, run_count, commit_sha,
    case when failures > 0 or errors > 0 then 'FAIL' when skipped > 0 and skipped = run_count then 'SKIPPED' else 'PASS' end outcome
  from firsts left join mapping using (job_id) where k = 1"""
)
def runs_ingest(spark: SparkSession, d: str) -> DataFrame:
    loaded = load_results(table(spark, d, "raw_results")).where("reason is null")
    runs = ingest.ingest_results(loaded, ingest.last_mapping(table(spark, d, "test_runs")))
    return runs.select("line_id", "repo", "job_id", "test_id", "test_index", F.round("duration_ms", 6).alias("duration_ms"), "run_count", "commit_sha", "outcome")


@query(f"select job job_id, arg_max(ref, id) commit_sha from (select {JOB} job, {SHA} ref, id from test_runs) where job is not null and ref is not null group by 1")
def commit_mapping_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_mapping(table(spark, d, "test_runs"))


@query(with_(CTE_RUNS) + "select distinct repo, job_id, job_sequence from runs")
def job_sequence_rank(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ranked_jobs(ingest.jobs_of(table(spark, d, "test_runs"))).select("repo", "job_id", F.col("job_sequence").cast("bigint").alias("job_sequence"))


SQL_STATS = (
    with_(CTE_RUNS, CTE_FILES)
    + """, stats as (select repo, count(*) n, cast(coalesce(sum(run_count), 0) as bigint) methods, count(*) filter (outcome = 'FAIL') failures, count(*) filter (outcome = 'ERROR') errors,
  count(distinct case when commit_sha is not null then job_id end) mapped_jobs, count(distinct job_id) builds, case when count(*) = 0 then 0.0::double else sum(failed) / count(*)::double end rate from runs group by repo),
judged as (select s.*, s.repo in (select repo from files) has_patches from stats s)"""
)


def project_frame(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"))
    per_job = runs.groupBy("repo", "job_id").agg(
        F.count("*").alias("n"),
        F.sum("run_count").alias("methods"),
        F.count_if(F.col("outcome") == "FAIL").alias("failures"),
        F.count_if(F.col("outcome") == "ERROR").alias("errors"),
        F.max(F.col("commit_sha").isNotNull()).alias("mapped"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    stats = per_job.groupBy("repo").agg(*map(total, ("n", "methods", "failures", "errors")), F.count_if("mapped").alias("mapped_jobs"), F.count("*").alias("builds"))
    stats = stats.withColumn("rate", F.coalesce(F.try_divide((F.col("failures") + F.col("errors")).cast("double"), F.col("n")), F.lit(0.0)))
    patched = files_of(spark, d).select("repo", F.lit(True).alias("has_patches")).distinct()
    return stats.join(patched, "repo", "left").withColumn("has_patches", F.coalesce("has_patches", F.lit(False)))


@query(SQL_STATS + " select repo, n, methods, failures, errors, mapped_jobs, builds, round(rate, 6) rate, has_patches from judged")
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    return project_frame(spark, d).select("repo", "n", "methods", "failures", "errors", "mapped_jobs", "builds", F.round("rate", 6).alias("rate"), "has_patches")


LEAST_RATE, LEAST_BUILDS, SELECTED = 0.01, 100, 5


@query(
    SQL_STATS
    + f""", marked as (select repo, rate, builds, concat_ws(', ', case when not has_patches then 'no patches' end, case when builds < {LEAST_BUILDS} then 'builds' end, case when rate < {LEAST_RATE} then 'failure rate' end) reasons from judged),
  chosen as (select repo, row_number() over (order by rate desc, lower(repo)) place from marked where reasons = '')
  select m.repo, round(rate, 6) rate, builds, case when place <= {SELECTED} then 'SELECTED' when reasons = '' then 'QUALIFIED' else 'REJECTED' end status, reasons from marked m left join chosen c on m.repo = c.repo"""
)
def project_selection_topn(spark: SparkSession, d: str) -> DataFrame:
    stats = project_frame(spark, d)
    reasons = F.concat_ws(", ", F.when(~F.col("has_patches"), "no patches"), F.when(F.col("builds") < LEAST_BUILDS, "builds"), F.when(F.col("rate") < LEAST_RATE, "failure rate"))
    marked = stats.select("repo", "rate", "builds", reasons.alias("reasons"))
    chosen = marked.where("reasons = ''").orderBy(F.desc("rate"), F.lower("repo")).limit(SELECTED).select("repo", F.lit(True).alias("in_top"))
    status = F.when(F.col("in_top"), "SELECTED").when(F.col("reasons") == "", "QUALIFIED").otherwise("REJECTED")
    return marked.join(chosen, "repo", "left").select("repo", F.round("rate", 6).alias("rate"), "builds", status.alias("status"), "reasons")


@query(
    SQL_STATS
    + f""", marked as (select least({SELECTED}, count(*)) selected from judged where has_patches and builds >= {LEAST_BUILDS} and rate >= {LEAST_RATE}) select selected, selected >= {quality.LEAST_PROJECTS} ok from marked"""
)
def selection_gate(spark: SparkSession, d: str) -> DataFrame:
    selected = project_selection_topn(spark, d).agg(F.count_if(F.col("status") == "SELECTED").alias("selected"))
    return selected.withColumn("ok", F.col("selected") >= quality.LEAST_PROJECTS)


# Timestamps


@query(with_(CTE_RUNS) + """select repo, commit_sha, count(*) n, count("timestamp") timestamped from runs where commit_sha is not null group by 1, 2""")
def commit_groups(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"), "commit_sha", "timestamp").where("commit_sha is not null")
    return runs.groupBy("repo", "commit_sha").agg(F.count("*").alias("n"), F.count("timestamp").alias("timestamped"))


SQL_MERGED = with_(CTE_RUNS, CTE_COMMITS) + """, merged as (select r.*, coalesce(r."timestamp", c.committed_ts) ts, c.commit_sha is not null resolved from runs r left join commit_ c on r.repo = c.repo and r.commit_sha = c.commit_sha)"""


def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with absent timestamps filled from their commit; present ones stay."""
    return ingest.merged_times(ingest.first_rows(table(spark, d, "test_runs"), "commit_sha", "timestamp"), commits_of(spark, d))


@query(SQL_MERGED + """ select id, ts, ts is not null and "timestamp" is null filled from merged""")
def timestamp_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged_runs(spark, d).select("id", "ts", (F.col("ts").isNotNull() & F.col("timestamp").isNull()).alias("filled"))


@query(
    SQL_MERGED
    + """ select repo, count(distinct commit_sha) shas, count(distinct case when resolved then commit_sha end) resolved_shas, count(commit_sha) eligible, count(case when commit_sha is not null then ts end) timestamped,
  round(coalesce(100.0::double * count(distinct case when resolved then commit_sha end) / nullif(count(distinct commit_sha), 0), 0), 6) sha_pct,
  round(coalesce(100.0::double * count(case when commit_sha is not null then ts end) / nullif(count(commit_sha), 0), 0), 6) row_pct from merged group by repo"""
)
def timestamp_coverage(spark: SparkSession, d: str) -> DataFrame:
    got = ingest.time_coverage(merged_runs(spark, d))
    return got.select("repo", "shas", "resolved_shas", "eligible", "timestamped", F.round("sha_pct", 6).alias("sha_pct"), F.round("row_pct", 6).alias("row_pct"))


@query("select repo, sha_pct, row_pct, sha_pct >= 70 and row_pct >= 70 ok from (" + SQL["timestamp_coverage"] + ")")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage_gate(timestamp_coverage(spark, d))


# Profiles


@query(with_(CTE_RUNS) + "select repo, count(*) n, count(distinct job_id) jobs, count(distinct test_id) tests from runs group by repo")
def per_repo_counts(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"), "failed")
    return runs.groupBy("repo").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"), F.count_distinct("test_id").alias("tests"))


@query(
    with_(CTE_RUNS)
    + """select repo, count(*) n, cast(sum(failed) as bigint) failures, count(*) filter (commit_sha is null) unmapped, round(avg(failed), 6) failure_rate, round(avg(case when commit_sha is null then 1.0::double else 0.0::double end), 6) unmapped_rate,
  avg(case when commit_sha is null then 1.0::double else 0.0::double end) > 0.4 unmapped_warning, avg(failed) < 0.02 failure_warning from runs group by repo"""
)
def outcome_quality(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"))
    got = runs.groupBy("repo").agg(F.count("*").alias("n"), F.sum("failed").alias("failures"), F.count_if(F.col("commit_sha").isNull()).alias("unmapped"))
    rate, null = F.col("failures") / F.col("n"), F.col("unmapped") / F.col("n")
    return got.select("repo", "n", "failures", "unmapped", F.round(rate, 6).alias("failure_rate"), F.round(null, 6).alias("unmapped_rate"), (null > 0.4).alias("unmapped_warning"), (rate < 0.02).alias("failure_warning"))


@query(with_(CTE_RUNS) + "select repo, outcome, count(*) n from runs group by all")
def outcome_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_rows(table(spark, d, "test_runs"), "outcome").groupBy("repo", "outcome").agg(F.count("*").alias("n"))


@query(with_(CTE_RUNS) + """select repo, test_id, failures, place from (select repo, test_id, cast(sum(failed) as bigint) failures, row_number() over (partition by repo order by sum(failed) desc, test_id) place from runs where failed = 1 group by 1, 2) where place <= 10""")
def top_failing_tests(spark: SparkSession, d: str) -> DataFrame:
    counts = ingest.first_rows(table(spark, d, "test_runs"), "failed").where("failed = 1").groupBy("repo", "test_id").agg(F.count("*").alias("failures"))
    by = ingest.Window.partitionBy("repo").orderBy(F.desc("failures"), "test_id")
    return counts.withColumn("place", F.row_number().over(by).cast("bigint")).where("place <= 10").select("repo", "test_id", "failures", "place")


@query(
    with_(CTE_RUNS)
    + """select repo, round(min(duration_ms), 4) low, round(quantile_cont(duration_ms, 0.5), 4) median, round(quantile_cont(duration_ms, 0.95), 4) p95, round(max(duration_ms), 4) high, round(avg(duration_ms), 4) mean,
  round(quantile_cont(duration_ms, 0.99), 4) p99 from runs where duration_ms > 0 group by repo"""
)
def duration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"), "duration_ms").where("duration_ms > 0")
    runs = stored(runs.select("repo", "duration_ms"), "durations")
    ends = runs.groupBy("repo").agg(F.min("duration_ms").alias("low"), F.max("duration_ms").alias("high"), F.avg("duration_ms").alias("mean"))
    got = ends.join(exact_percentiles(runs, "repo", "duration_ms", (0.5, 0.95, 0.99)), "repo")
    r = lambda c, n: F.round(c, 4).alias(n)
    return got.select("repo", r("low", "low"), r("p0", "median"), r("p1", "p95"), r("high", "high"), r("mean", "mean"), r("p2", "p99"))


@query(with_(CTE_FILES) + "select repo, count(*) changes, count(distinct commit_sha) commits from files group by repo")
def file_change_profile(spark: SparkSession, d: str) -> DataFrame:
    per_commit = files_of(spark, d).groupBy("repo", "commit_sha").agg(F.count("*").alias("n"))
    return per_commit.groupBy("repo").agg(F.sum("n").alias("changes"), F.count("*").alias("commits"))


@query(with_(CTE_RUNS) + "select repo, min(job_sequence) first_job, max(job_sequence) last_job, count(distinct job_sequence) sequences, count(distinct job_id) jobs, max(job_sequence) = count(distinct job_id) and min(job_sequence) = 1 contiguous from runs group by repo")
def job_sequence_audit(spark: SparkSession, d: str) -> DataFrame:
    jobs = ingest.ranked_jobs(ingest.jobs_of(table(spark, d, "test_runs"))).withColumn("job_sequence", F.col("job_sequence").cast("bigint"))
    got = jobs.groupBy("repo").agg(F.min("job_sequence").alias("first_job"), F.max("job_sequence").alias("last_job"), F.count_distinct("job_sequence").alias("sequences"), F.count("*").alias("jobs"))
    return got.withColumn("contiguous", (F.col("last_job") == F.col("jobs")) & (F.col("first_job") == 1))


@query(with_(CTE_RUNS) + """select repo, count(*) n, count(commit_sha) mapped, count("timestamp") timestamped, count(job_sequence) sequenced, sum(count(*)) over () >= 10000 enough from runs group by repo""")
def smoke_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"))
    got = runs.groupBy("repo").agg(F.count("*").alias("n"), F.count("commit_sha").alias("mapped"), F.count("timestamp").alias("timestamped"), F.count("job_id").alias("sequenced"))
    return got.withColumn("enough", F.sum("n").over(ingest.Window.partitionBy(F.lit(1))) >= 10000)


@query(
    SQL_LINES
    + f""", offenders as (select distinct cast(f[1] as bigint) job_id from lines where reason is null and (coalesce(try_cast(f[6] as bigint), 0) > 0 or coalesce(try_cast(f[7] as bigint), 0) > 0)),
  {CTE_RUNS} select repo, count(*) failed_rows, count(o.job_id) matched, round(100.0::double * count(o.job_id) / count(*), 6) matched_pct, 100.0 * count(o.job_id) / count(*) < 50 warning
  from runs r left join offenders o on r.job_id = o.job_id where failed = 1 group by repo"""
)
def offender_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    loaded = load_results(table(spark, d, "raw_results")).where("reason is null and (failures > 0 or errors > 0)")
    offenders = loaded.select("job_id", F.lit(1).alias("hit")).distinct()
    rows = ingest.first_rows(table(spark, d, "test_runs")).where("failed = 1").join(offenders, "job_id", "left")
    pct = 100.0 * F.col("matched") / F.col("failed_rows")
    return rows.groupBy("repo").agg(F.count("*").alias("failed_rows"), F.count("hit").alias("matched")).select("repo", "failed_rows", "matched", F.round(pct, 6).alias("matched_pct"), (pct < 50).alias("warning"))


# Commits


@query(
    with_(CTE_FILES)
    + """select repo, commit_sha, count(*) files_changed_total, count(*) filter (lower(file_path) like '%.java') java_files_changed,
  count(*) filter (lower(file_path) like '%.java' and (contains(lower(file_path), '/test/') or starts_with(lower(file_path), 'test/'))) test_files_changed,
  count(*) filter (lower(file_path) like '%.java' and not (contains(lower(file_path), '/test/') or starts_with(lower(file_path), 'test/'))) source_files_changed from files group by 1, 2"""
)
def file_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.file_counts(files_of(spark, d))


@query(with_(CTE_FILES) + "select repo, commit_sha, string_agg(file_path, '|' order by file_path) paths from files group by 1, 2")
def changed_files_per_commit(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).groupBy("repo", "commit_sha").agg(F.concat_ws("|", F.array_sort(F.collect_list("file_path"))).alias("paths"))


SQL_SCORE = " + ".join(f"cast(regexp_matches(lower(coalesce(message, '')), '(^|[^a-z0-9_]){w}($|[^a-z0-9_])') as int)" for w in C.RISK_KEYWORDS)
SQL_LOCAL = "(authored_at + to_minutes(coalesce(utc_offset_min, 0)))"


@query(with_(CTE_COMMITS) + f"select repo, commit_sha, cast(hour({SQL_LOCAL}) as int) commit_hour, cast(isodow({SQL_LOCAL}) - 1 as int) commit_day_of_week, {SQL_SCORE} keyword_risk_score from commit_")
def commit_calendar_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = commits_of(spark, d)
    local = F.expr("authored_at + make_dt_interval(0, 0, coalesce(utc_offset_min, 0), 0)")
    return rows.select("repo", "commit_sha", F.hour(local).alias("commit_hour"), F.weekday(local).alias("commit_day_of_week"), C.keyword_score(F.col("message")).alias("keyword_risk_score"))


CTE_COMMIT_FEATURES = f"""counts_ as (select repo, commit_sha, count(*) n, count(*) filter (lower(file_path) like '%.java') j, count(*) filter (lower(file_path) like '%.java' and (contains(lower(file_path), '/test/') or starts_with(lower(file_path), 'test/'))) t from files group by 1, 2),
keys_ as (select distinct repo, commit_sha from runs where commit_sha is not null),
commit_features as (select k.repo, k.commit_sha, coalesce(n, 0) files_changed_total, coalesce(j, 0) java_files_changed, coalesce(j, 0) - coalesce(t, 0) source_files_changed, coalesce(t, 0) test_files_changed, 0 lines_added, 0 lines_deleted, 0 churn_total,
  coalesce(cast(m.parent_count > 1 as int), 0) is_merge_commit, coalesce(cast(hour({SQL_LOCAL}) as int), 0) commit_hour, coalesce(cast(isodow({SQL_LOCAL}) - 1 as int), 0) commit_day_of_week,
  case when m.commit_sha is null then 0 else {SQL_SCORE} end keyword_risk_score, cast(m.commit_sha is null as int) commit_meta_missing, case when m.commit_sha is not null and m.parent_count = 0 then 0 else 1 end commit_diff_missing
  from keys_ k left join counts_ f on k.repo = f.repo and k.commit_sha = f.commit_sha left join commit_ m on k.repo = m.repo and k.commit_sha = m.commit_sha)"""


@query(with_(CTE_RUNS, CTE_COMMITS, CTE_FILES, CTE_COMMIT_FEATURES) + "select * from commit_features")
def commit_features(spark: SparkSession, d: str) -> DataFrame:
    keys = ingest.first_rows(table(spark, d, "test_runs")).where("commit_sha is not null").select("repo", "commit_sha").distinct()
    return C.commit_features(keys, commits_of(spark, d), files_of(spark, d))


CTE_AUTHORED = """authored as (select r.repo, r.commit_sha, c.author_email, c.committed_ts ts, max(failed) failed, min(job_sequence) first_seq, min(case when failed = 1 then job_sequence end) first_fail
  from runs r join commit_ c on r.repo = c.repo and r.commit_sha = c.commit_sha where c.author_email is not null group by all),
by_time as (select repo, commit_sha, count(*) over w n, coalesce(sum(failed) over w, 0) f from authored where ts is not null window w as (partition by repo, author_email order by ts range between 7776000 preceding and 1 preceding)),
author_time as (select repo, commit_sha, n author_commit_count_90d, case when n < 3 then -1.0::double else f / n::double end author_failure_rate_90d, 0 author_feature_fallback, 'timestamp' feature_source from by_time),
events_ as (select repo, author_email, commit_sha, first_seq seq, 1 c, 0 f from authored union all select repo, author_email, null, first_fail, 0, 1 from authored where first_fail is not null),
by_seq as (select *, coalesce(sum(c) over w, 0) n, coalesce(sum(f) over w, 0) fs from events_ window w as (partition by repo, author_email order by seq range between unbounded preceding and 1 preceding)),
author_seq as (select repo, commit_sha, n author_commit_count_90d, case when n < 3 then -1.0::double else fs / n::double end author_failure_rate_90d, 1 author_feature_fallback, 'job_sequence' feature_source from by_seq where c = 1)"""
AUTHOR_OUT = "repo, commit_sha, cast(author_commit_count_90d as bigint) author_commit_count_90d, round(author_failure_rate_90d, 6) author_failure_rate_90d, author_feature_fallback, feature_source"


def author_columns(df: DataFrame) -> DataFrame:
    return df.select("repo", "commit_sha", F.col("author_commit_count_90d").cast("bigint").alias("author_commit_count_90d"), F.round("author_failure_rate_90d", 6).alias("author_failure_rate_90d"), "author_feature_fallback", "feature_source")


@query(with_(CTE_RUNS, CTE_COMMITS, CTE_AUTHORED) + f"select {AUTHOR_OUT} from author_time")
def author_features_ts(spark: SparkSession, d: str) -> DataFrame:
    return author_columns(C.author_by_time(C.author_commits(runs_of(spark, d, "commit_sha", "failed"), commits_of(spark, d))))


@query(with_(CTE_RUNS, CTE_COMMITS, CTE_AUTHORED) + f"select {AUTHOR_OUT} from author_seq")
def author_features_seq(spark: SparkSession, d: str) -> DataFrame:
    return author_columns(C.author_by_sequence(C.author_commits(runs_of(spark, d, "commit_sha", "failed"), commits_of(spark, d))))


# History

CTE_HISTORY = """placed as (select *, row_number() over w pos from runs window w as (partition by repo, test_id order by ets, job_sequence)),
state as (select *, pos - coalesce(max(case when failed = 1 then pos end) over (partition by repo, test_id order by ets, job_sequence rows between unbounded preceding and current row), 0) streak,
  avg(duration_ms) over w20 m20, var_pop(duration_ms) over w20 v20, count(duration_ms) over w20 n20 from placed window w20 as (partition by repo, test_id order by ets, job_sequence rows between 19 preceding and current row)),
seen as (select *, arg_max(struct_pack(ets := ets, failed := failed, streak := streak, m20 := m20, v20 := v20, n20 := n20), (ets, job_sequence)) over prior_ last_, max(case when failed = 1 then ets end) over prior_ fail_at,
  count(*) over d7 c7, sum(failed) over d7 f7, count(*) over d30 c30, sum(failed) over d30 f30, count(*) over d90 c90, sum(failed) over d90 f90 from state
  window prior_ as (partition by repo, test_id order by ets range between unbounded preceding and 1 preceding), d7 as (partition by repo, test_id order by ets range between 604800 preceding and 1 preceding),
  d30 as (partition by repo, test_id order by ets range between 2592000 preceding and 1 preceding), d90 as (partition by repo, test_id order by ets range between 7776000 preceding and 1 preceding)),
history as (select *, coalesce(last_.failed, -1) last_outcome, case when c7 > 0 then f7 / c7::double else -1.0::double end failure_rate_7d, case when c30 > 0 then f30 / c30::double else -1.0::double end failure_rate_30d,
  case when c90 > 0 then f90 / c90::double else -1.0::double end failure_rate_90d, coalesce((ets - fail_at) / 86400.0::double, 999.0::double) days_since_last_fail, coalesce((ets - last_.ets) / 86400.0::double, 999.0::double) days_since_last_run,
  coalesce(last_.streak, 0) consecutive_passes, coalesce(last_.m20, 0.0::double) avg_duration_ms, case when last_.n20 >= 2 then last_.v20 else 0.0::double end duration_variance, c30 run_count_30d from seen)"""
SQL_HISTORY_COLUMNS = {
    "last_outcome": "last_outcome",
    "failure_rate_7d": "round(failure_rate_7d, 6)",
    "failure_rate_30d": "round(failure_rate_30d, 6)",
    "failure_rate_90d": "round(failure_rate_90d, 6)",
    "days_since_last_fail": "days_since_last_fail",
    "days_since_last_run": "days_since_last_run",
    "consecutive_passes": "cast(consecutive_passes as bigint)",
    "avg_duration_ms": "round(avg_duration_ms, 4)",
    "duration_variance": "case when duration_variance < 1e-9 then 0.0::double else floor(duration_variance / pow(2.0::double, floor(log2(duration_variance)) - 20) + 0.2863719::double) * pow(2.0::double, floor(log2(duration_variance)) - 20) end",
    "run_count_30d": "cast(run_count_30d as bigint)",
}


def history_sql(*columns: str) -> str:
    return with_(CTE_RUNS, CTE_HISTORY) + "select id, " + ", ".join(f"{SQL_HISTORY_COLUMNS[c]} {c}" for c in columns) + " from history"


def rounded(c: str):
    if c in ("last_outcome", "days_since_last_fail", "days_since_last_run"):
        return F.col(c)
    if c in ("consecutive_passes", "run_count_30d"):
        return F.col(c).cast("bigint").alias(c)
    if c == "duration_variance":
        # 21 binary digits, in which sums in different order agree; cut off the halves and tenths in which variances of few runs end
        step = F.pow(F.lit(2.0), F.floor(F.log2(c)) - 20)
        return F.when(F.col(c) < 1e-9, F.lit(0.0)).otherwise(F.floor(F.col(c) / step + 0.2863719) * step).alias(c)
    return F.round(c, 4 if c == "avg_duration_ms" else 6).alias(c)


def history_query(name: str, *columns: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return history.test_history(timed_runs(spark, d)).select("id", *[rounded(c) for c in columns])

    QUERIES[name] = run
    SQL[name] = history_sql(*columns)


history_query("history_last_outcome", "last_outcome", "days_since_last_run")
history_query("history_failure_rates", "failure_rate_7d", "failure_rate_30d", "failure_rate_90d")
history_query("history_days_since_fail", "days_since_last_fail")
history_query("history_pass_streak", "consecutive_passes")
history_query("history_duration_last20", "avg_duration_ms", "duration_variance")
history_query("history_run_count_30d", "run_count_30d")
history_query("test_history_features", *history.COLUMNS)

# Dependencies


def referenced_classes(documents: DataFrame) -> DataFrame:
    """(cls, name): the classes that Java code in documents creates, standing for the imports of the class the code is of. A text may hold the code of
    several classes, each from its ``public class`` to the next."""
    parts = F.split("text", "public class ")
    code = documents.where(F.col("text").contains("public class ")).select(F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("code"))
    return code.select(F.regexp_extract("code", r"^(\w+)", 1).alias("cls"), F.explode(F.regexp_extract_all("code", F.lit(r"new (\w+)\("), F.lit(1))).alias("name")).where("cls <> ''").distinct()


def test_imports(spark: SparkSession, d: str, tests: DataFrame) -> DataFrame:
    """(repo, test_id, name) for the tests whose class some code in documents is of; the code names no repo, so it counts in all that have the test."""
    own = tests.select("repo", "test_id").distinct().withColumn("cls", F.substring_index("test_id", ".", -1))
    return own.join(referenced_classes(table(spark, d, "documents")), "cls").select("repo", "test_id", "name")


SQL_PACKAGE = lambda p: rf"replace(regexp_extract(case when contains({p}, 'src/main/java/') then regexp_extract({p}, 'src/main/java/(.*)$', 1) else regexp_extract({p}, 'src/test/java/(.*)$', 1) end, '^(.*)/[^/]*$', 1), '/', '.')"
SQL_MODULE = lambda p: f"case when contains({p}, '/') then split_part({p}, '/', 1) else '.' end"
CTE_DEPENDENCY = rf"""sources as (select repo, test_id, arg_min(file_path, (length(file_path), file_path)) path from (
  select distinct repo, file_path, replace(regexp_replace(regexp_extract(file_path, 'src/test/java/(.*)$', 1), '\.[^./]*$', ''), '/', '.') test_id from files where contains(file_path, 'src/test/java/') and lower(file_path) like '%.java') group by 1, 2),
tests as (select distinct repo, commit_sha, test_id from runs where commit_sha is not null),
segments as (select unnest(string_split(text, 'public class ')[2:]) code from documents where contains(text, 'public class ')),
code as (select distinct * from (select regexp_extract(code, '^([0-9A-Za-z_]+)', 1) cls, unnest(regexp_extract_all(code, 'new ([0-9A-Za-z_]+)\(', 1)) as name from segments) where cls <> ''),
overlap as (select t.repo, t.commit_sha, t.test_id, count(distinct f.file_path) n from tests t join code c on regexp_extract(t.test_id, '([^.]*)$', 1) = c.cls
  join files f on f.repo = t.repo and f.commit_sha = t.commit_sha and lower(f.file_path) like '%.java' and regexp_extract(f.file_path, '([^/]+?)(\.[^./]*)?$', 1) = c.name group by all),
placed_files as (select *, {SQL_PACKAGE('file_path')} package, {SQL_MODULE('file_path')} module from files),
joined as (select t.*, s.path, {SQL_PACKAGE('s.path')} tp, {SQL_MODULE('s.path')} tm from tests t left join sources s on t.repo = s.repo and t.test_id = s.test_id),
dependency as (select j.repo, j.commit_sha, j.test_id,
  cast(j.path is not null and exists (from files f where f.repo = j.repo and f.commit_sha = j.commit_sha and f.file_path = j.path) as int) test_file_touched,
  case when j.path is null then 0 else coalesce((select n from overlap o where o.repo = j.repo and o.commit_sha = j.commit_sha and o.test_id = j.test_id), 0) end import_overlap,
  cast(j.path is not null and exists (from placed_files f where f.repo = j.repo and f.commit_sha = j.commit_sha and f.package = j.tp) as int) same_package,
  cast(coalesce((select count(*) from placed_files f where f.repo = j.repo and f.commit_sha = j.commit_sha and f.module = j.tm and j.path is not null), 0) as int) changed_files_in_module, cast(j.path is null as int) dependency_parse_failed from joined j)"""


def dependency_query(name: str, *columns: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tests = ingest.first_rows(table(spark, d, "test_runs")).where("commit_sha is not null")
        return dependency.dependency_features(tests, stored(files_of(spark, d), "files")).select("repo", "commit_sha", "test_id", *columns)

    QUERIES[name] = run
    SQL[name] = with_(CTE_RUNS, CTE_FILES, CTE_DEPENDENCY) + f"select repo, commit_sha, test_id, {', '.join(columns)} from dependency"


dependency_query("dependency_touch", "test_file_touched", "dependency_parse_failed")
dependency_query("dependency_same_package", "same_package")
dependency_query("dependency_module_files", "changed_files_in_module")


@query(with_(CTE_RUNS, CTE_FILES, CTE_DEPENDENCY) + "select repo, commit_sha, test_id, n import_overlap from overlap")
def dependency_import_overlap(spark: SparkSession, d: str) -> DataFrame:
    tests = stored(ingest.first_rows(table(spark, d, "test_runs"), "commit_sha").where("commit_sha is not null").select("repo", "commit_sha", "test_id").distinct(), "tests")
    return dependency.import_overlap(tests, test_imports(spark, d, tests), files_of(spark, d))


# Matrix, gates, splits


def matrix_of(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    runs = stored(runs_of(spark, d), "runs")
    return matrix.feature_matrix(runs, commits_of(spark, d), stored(files_of(spark, d), "files"), imports=test_imports(spark, d, runs), carry=carry)


CTE_MATRIX = """author_features as (select * from author_time union all select * from author_seq s where not exists (from author_time t where t.repo = s.repo and t.commit_sha = s.commit_sha)),
matrix as (select h.id, h.repo, h.commit_sha, h.test_id, h.failed label, h."timestamp", h.job_sequence, """ + ", ".join(
    [f"coalesce(c.{c}, {1 if c.endswith('missing') else 0}) {c}" for c in C.COMMIT_COLUMNS]
    + ["coalesce(a.author_commit_count_90d, 0) author_commit_count_90d", "coalesce(a.author_failure_rate_90d, -1.0::double) author_failure_rate_90d", "coalesce(a.author_feature_fallback, 1) author_feature_fallback", "coalesce(a.feature_source, 'job_sequence') feature_source"]
    + [f"h.{c}" for c in history.COLUMNS]
    + [f"coalesce(d.{c}, {1 if c == 'dependency_parse_failed' else 0}) {c}" for c in dependency.COLUMNS]
) + """ from history h left join commit_features c on h.repo = c.repo and h.commit_sha = c.commit_sha left join author_features a on h.repo = a.repo and h.commit_sha = a.commit_sha
  left join dependency d on h.repo = d.repo and h.commit_sha = d.commit_sha and h.test_id = d.test_id)"""
WITH_MATRIX = with_(CTE_RUNS, CTE_COMMITS, CTE_FILES, CTE_COMMIT_FEATURES, CTE_AUTHORED, CTE_HISTORY, CTE_DEPENDENCY, CTE_MATRIX)
INTEGERS = ("author_commit_count_90d", *C.COMMIT_COLUMNS, *dependency.COLUMNS)


@query(
    WITH_MATRIX
    + "select id, repo, commit_sha, test_id, label, \"timestamp\", cast(job_sequence as bigint) job_sequence, "
    + ", ".join([f"cast({c} as bigint) {c}" for c in INTEGERS] + ["round(author_failure_rate_90d, 6) author_failure_rate_90d", "author_feature_fallback", "feature_source"] + [f"{SQL_HISTORY_COLUMNS[c]} {c}" for c in history.COLUMNS])
    + " from matrix"
)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = matrix_of(spark, d, "id")
    whole = [F.col(c).cast("bigint").alias(c) for c in INTEGERS]
    return m.select("id", "repo", "commit_sha", "test_id", "label", "timestamp", F.col("job_sequence").cast("bigint").alias("job_sequence"), *whole, F.round("author_failure_rate_90d", 6).alias("author_failure_rate_90d"), "author_feature_fallback", "feature_source", *[rounded(c) for c in history.COLUMNS])


@query(
    WITH_MATRIX
    + " union all ".join(f"""select '{c}' "column", count(*) filter ({c if c != 'timestamp' else '"timestamp"'} is null) nulls, round(avg(cast({c if c != 'timestamp' else '"timestamp"'} is null as int)), 6) share from matrix""" for c in matrix.COLUMNS)
)
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_profile(matrix_of(spark, d)).select("column", "nulls", F.round("share", 6).alias("share"))


@query(WITH_MATRIX + "select repo, count(*) \"rows\", round(100 * avg(cast(feature_source = 'job_sequence' as int)), 6) by_sequence_pct from matrix group by repo")
def source_ratio_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_shares(matrix_of(spark, d)).select("repo", "rows", F.round("by_sequence_pct", 6).alias("by_sequence_pct"))


@query(WITH_MATRIX + "select repo, count(*) \"rows\", cast(sum(label) as bigint) failures, round(avg(label), 6) failure_rate, round(100 * avg(cast(feature_source = 'job_sequence' as int)), 6) by_sequence_pct, round(100 * avg(commit_meta_missing), 6) meta_missing_pct from matrix group by repo")
def matrix_by_repo(spark: SparkSession, d: str) -> DataFrame:
    got = quality.repo_profile(matrix_of(spark, d))
    return got.select("repo", "rows", "failures", *[F.round(c, 6).alias(c) for c in ("failure_rate", "by_sequence_pct", "meta_missing_pct")])


SQL_SIDES = with_(CTE_RUNS) + ", sides as (select *, case when job_sequence <= cast(floor(0.8::double * max(job_sequence) over (partition by repo)) as bigint) then 'train' else 'test' end side from runs)"


@query(SQL_SIDES + " select repo, side, count(*) n, count(distinct job_sequence) jobs, min(job_sequence) first_job, max(job_sequence) last_job from sides group by 1, 2")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    sides = split.split_sides(runs_of(spark, d)).withColumn("job_sequence", F.col("job_sequence").cast("bigint"))
    return sides.groupBy("repo", "side").agg(F.count("*").alias("n"), F.count_distinct("job_sequence").alias("jobs"), F.min("job_sequence").alias("first_job"), F.max("job_sequence").alias("last_job"))


@query(with_(CTE_RUNS) + ", jobs as (select distinct repo, job_id, job_sequence from runs) select repo, job_id, cast(floor((job_sequence - 1) * 6 / (max(job_sequence) over (partition by repo))::double) as int) fold from jobs")
def time_series_folds(spark: SparkSession, d: str) -> DataFrame:
    return split.time_folds(ingest.ranked_jobs(ingest.jobs_of(table(spark, d, "test_runs"))), 5).select("repo", "job_id", "fold")


NUMERIC = tuple(c for c in matrix.COLUMNS if c not in (*matrix.KEYS, "feature_source"))


@query(WITH_MATRIX + " union all ".join(f"select '{c}' feature, round(abs({sql_corr(c, 'label')}), 6) correlation from matrix" for c in NUMERIC))
def label_correlation(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.label_correlation(matrix_of(spark, d), NUMERIC)
    return got.select("feature", F.round("correlation", 6).alias("correlation"))


def top_features(m: DataFrame, n: int) -> tuple[str, ...]:
    """The n features of greatest correlation with the label; the matrix has few columns."""
    tied = evaluate.label_correlation(m, NUMERIC).withColumn("correlation", F.round("correlation", 6)).where("correlation is not null")
    return tuple(r["feature"] for r in tied.orderBy(F.desc("correlation"), "feature").limit(n).collect())


@query("select * from (" + SQL["label_correlation"] + ") where correlation is not null order by correlation desc, feature limit 15")
def label_correlation_top15(spark: SparkSession, d: str) -> DataFrame:
    return label_correlation(spark, d).where("correlation is not null").orderBy(F.desc("correlation"), "feature").limit(15)


@query()
def label_information_top5(spark: SparkSession, d: str) -> DataFrame:
    return label_information(spark, d).orderBy(F.desc("information"), "feature").limit(5)


@query(
    WITH_MATRIX
    + " union all ".join(f"select '{c}' feature, count(*) filter ({c}::double not in (999, -1)) known, round(avg({c}::double) filter ({c}::double not in (999, -1)), 4) mean from matrix" for c in history.COLUMNS if c != "duration_variance")
)
def known_feature_means(spark: SparkSession, d: str) -> DataFrame:
    got = matrix.known_means(history.test_history(timed_runs(spark, d)), tuple(c for c in history.COLUMNS if c != "duration_variance"))
    return got.select("feature", "known", F.round("mean", 4).alias("mean"))


@query(with_(CTE_RUNS) + """select repo, test_id, coalesce(bool_and(fine), true) ok from (select repo, test_id, "timestamp" >= lag("timestamp") over (partition by repo, test_id order by job_sequence) fine from runs where "timestamp" is not null) group by 1, 2""")
def monotonic_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.monotonic(runs_of(spark, d, "failed"))


@query()
def label_information(spark: SparkSession, d: str) -> DataFrame:
    """Of the features one by one: each is counted where it arises, per run, commit or key of its files; no matrix is made."""
    runs = stored(runs_of(spark, d, "commit_sha", "duration_ms", "failed").select("repo", "commit_sha", "test_id", "failed", "duration_ms", "ets", "job_sequence"), "runs", tidy=True)
    past = evaluate.contingency(history.test_history(runs, ("failed",), is_stored=True), history.COLUMNS, "failed")
    rest = matrix.value_counts(runs, commits_of(spark, d), stored(files_of(spark, d), "files", tidy=True), imports=test_imports(spark, d, runs))
    return evaluate.information(past.unionByName(evaluate.cut_counts(rest)))


@query(with_(CTE_RUNS) + "select repo, commit_sha, test_id, failed label, null::bigint tests from runs union all select repo, null, null, null, count(distinct test_id) from runs group by repo")
def union_projects(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs"))
    rows = runs.select("repo", "commit_sha", "test_id", F.col("failed").alias("label"))
    return split.union_projects([rows, runs.groupBy("repo").agg(F.count_distinct("test_id").alias("tests"))])


# Evaluation


def ordered_runs(spark: SparkSession, d: str) -> DataFrame:
    return history.test_history(timed_runs(spark, d), ("id", "repo", "job_sequence", "test_id", "failed", "duration_ms"))


SQL_ORDERS = {
    "mrf": "days_since_last_fail, test_id",
    "alphabetical": "test_id",
    "random": "md5('42|' || test_id), test_id",
}


def sql_ranked(order: str) -> str:
    return with_(CTE_RUNS, CTE_HISTORY) + f", ranked as (select *, row_number() over (partition by repo, job_sequence order by {SQL_ORDERS[order]}) rank_ from history)"


def ranks(spark: SparkSession, d: str, order: str) -> DataFrame:
    by = {"mrf": evaluate.mrf_order(), "alphabetical": [F.col("test_id")], "random": evaluate.random_order(42)}[order]
    return evaluate.ranked(ordered_runs(spark, d) if order == "mrf" else timed_runs(spark, d), *by)


SQL_APFD = """ select repo, cast(job_sequence as bigint) job_sequence, count(*) tests, cast(sum(failed) as bigint) faults,
  round(case when sum(failed) > 0 then 1 - sum(rank_ * failed) / (count(*) * sum(failed))::double + 1 / (2 * count(*))::double else 0.0::double end, 6) apfd from ranked group by repo, job_sequence"""


SQL_MEASURED = """, measured as (select repo, cast(job_sequence as bigint) job_sequence,
  case when sum(failed) > 0 then 1 - sum(rank_ * failed) / (count(*) * sum(failed))::double + 1 / (2 * count(*))::double else 0.0::double end apfd from ranked group by repo, job_sequence"""


def apfd_query(order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return evaluate.apfd(ranks(spark, d, order)).select("repo", F.col("job_sequence").cast("bigint").alias("job_sequence"), "tests", "faults", F.round("apfd", 6).alias("apfd"))

    QUERIES[f"apfd_{order}"] = run
    SQL[f"apfd_{order}"] = sql_ranked(order) + SQL_APFD


for _order in SQL_ORDERS:
    apfd_query(_order)


@query(sql_ranked("mrf") + ' select id, rank_ as "rank" from ranked')
def mrf_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranks(spark, d, "mrf").select("id", F.col("rank").cast("bigint").alias("rank"))


@query(
    sql_ranked("mrf")
    + """, done as (select *, coalesce(duration_ms, 0.0) c, sum(coalesce(duration_ms, 0.0)) over (partition by repo, job_sequence order by rank_ rows unbounded preceding) so_far from ranked)
  select repo, cast(job_sequence as bigint) job_sequence, cast(sum(failed) as bigint) faults, round(case when sum(failed) > 0 and sum(c) > 0 then 1 - sum(case when failed = 1 then so_far - c / 2 else 0.0 end) / (sum(c) * sum(failed)) else 0.0 end, 6) apfdc from done group by repo, job_sequence"""
)
def apfdc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.apfdc(ranks(spark, d, "mrf")).select("repo", F.col("job_sequence").cast("bigint").alias("job_sequence"), "faults", F.round("apfdc", 6).alias("apfdc"))


@query(
    sql_ranked("mrf")
    + """ select repo, cast(job_sequence as bigint) job_sequence, round(sum(case when rank_ <= 5 then failed else 0 end) / least(5, count(*))::double, 6) "precision", round(sum(case when rank_ <= 5 then failed else 0 end) / sum(failed)::double, 6) recall
  from ranked group by repo, job_sequence having sum(failed) > 0"""
)
def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.precision_recall(ranks(spark, d, "mrf"), 5)
    return got.select("repo", F.col("job_sequence").cast("bigint").alias("job_sequence"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    sql_ranked("mrf")
    + SQL_MEASURED
    + " having sum(failed) > 0) select repo, count(*) jobs, round(avg(apfd), 9) mean, round(stddev_pop(apfd), 6) deviation from measured group by repo"
)
def apfd_by_repo(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.apfd(ranks(spark, d, "mrf")).where("faults > 0")
    return rows.groupBy("repo").agg(F.count("*").alias("jobs"), F.round(F.avg("apfd"), 9).alias("mean"), F.round(F.stddev_pop("apfd"), 6).alias("deviation"))


@query(
    sql_ranked("mrf")
    + SQL_MEASURED
    + """ having sum(failed) > 0), days as (select repo, job_sequence, cast(floor(min("timestamp") / 86400) as bigint) day_no from runs where "timestamp" is not null group by 1, 2)
  select repo, day_no, count(*) jobs, round(avg(apfd), 9) mean from measured join days using (repo, job_sequence) group by 1, 2"""
)
def daily_apfd(spark: SparkSession, d: str) -> DataFrame:
    """Of the jobs with a fault, by the day of their first timed run."""
    keys = list(evaluate.JOB)
    days = runs_of(spark, d, "failed").where("timestamp is not null").groupBy(*keys).agg(F.floor(F.min("timestamp") / 86400).alias("day_no"))
    rows = evaluate.apfd(ranks(spark, d, "mrf")).where("faults > 0").join(days, keys)
    return rows.groupBy("repo", "day_no").agg(F.count("*").alias("jobs"), F.round(F.avg("apfd"), 9).alias("mean"))


SQL_CROSS = (
    SQL_SIDES
    + f""", {CTE_FILES}, failed_ as (select repo, file_path, test_id, count(*) n from sides s join files f using (repo, commit_sha) where side = 'train' and failed = 1 group by all),
  now_ as (select distinct repo, commit_sha, test_id from sides where side = 'test' and commit_sha is not null),
  changed_ as (select repo, file_path, count(*) m from files f where (repo, commit_sha) in (select repo, commit_sha from sides where side = 'train') group by all)"""
)


def matrix_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    sides = stored(split.split_sides(runs_of(spark, d)).select("repo", "commit_sha", "test_id", "failed", "side").where("commit_sha is not null"), "sides")
    files = stored(files_of(spark, d), "files")
    train = sides.where("side = 'train'")
    changes = files.join(train.select("repo", "commit_sha").distinct(), ["repo", "commit_sha"], "left_semi").groupBy("repo", "file_path").agg(F.count("*").alias("changed"))
    return sides.where("side = 'test'"), files, evaluate.failure_matrix(train.where("failed = 1"), files), changes


@query(SQL_CROSS + " select n.repo, n.commit_sha, n.test_id, round(coalesce(sum(m.n), 0)::double, 6) score from now_ n left join files f on n.repo = f.repo and n.commit_sha = f.commit_sha left join failed_ m on m.repo = f.repo and m.file_path = f.file_path and m.test_id = n.test_id group by all")
def matrix_naive(spark: SparkSession, d: str) -> DataFrame:
    current, files, m, _ = matrix_parts(spark, d)
    return evaluate.matrix_scores(current, files, m).withColumn("score", F.round("score", 6))


@query(
    SQL_CROSS
    + " select n.repo, n.commit_sha, n.test_id, round(coalesce(sum(m.n / c.m::double), 0.0::double), 6) score from now_ n left join files f on n.repo = f.repo and n.commit_sha = f.commit_sha left join failed_ m on m.repo = f.repo and m.file_path = f.file_path and m.test_id = n.test_id left join changed_ c on c.repo = m.repo and c.file_path = m.file_path group by all"
)
def matrix_conditional(spark: SparkSession, d: str) -> DataFrame:
    current, files, m, changes = matrix_parts(spark, d)
    return evaluate.matrix_scores(current, files, m, changes).withColumn("score", F.round("score", 6))


THRESHOLDS = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


@query(
    with_(CTE_RUNS, CTE_HISTORY)
    + f""", scored as (select *, 0.01 + greatest(failure_rate_90d, 0.0) score from history), ranked as (select *, row_number() over (partition by repo, job_sequence order by round(score, 9) desc, test_id) rank_ from scored),
  shares as (select *, coalesce(sum(score) over (partition by repo, job_sequence order by rank_ rows between unbounded preceding and 1 preceding), 0.0) / sum(score) over (partition by repo, job_sequence) before_ from ranked),
  at_ as (select *, unnest([{', '.join(f'{t}::double' for t in THRESHOLDS)}]) threshold from shares)
  select threshold, count(*) tests, round(avg(cast(round(before_, 9) <= threshold as int)), 6) share_run, round(sum(case when round(before_, 9) > threshold then failed else 0 end) / sum(failed)::double, 6) fault_miss_rate from at_ group by threshold"""
)
def early_exit_sweep(spark: SparkSession, d: str) -> DataFrame:
    scored = ordered_runs_with_score(spark, d)
    got = evaluate.early_exit(evaluate.ranked(scored, F.round("score", 9).desc(), F.col("test_id")), "score", THRESHOLDS)
    return got.select("threshold", "tests", F.round("share_run", 6).alias("share_run"), F.round("fault_miss_rate", 6).alias("fault_miss_rate"))


@query(
    SQL["early_exit_sweep"].split(" select threshold, count(*)")[0]
    + """ select threshold, round(sum(coalesce(duration_ms, 0.0)), 1) total_ms, round(sum(case when round(before_, 9) > threshold then coalesce(duration_ms, 0.0) else 0.0 end), 1) saved_ms,
  round(sum(case when round(before_, 9) > threshold then coalesce(duration_ms, 0.0) else 0.0 end) / sum(coalesce(duration_ms, 0.0)), 6) saved_share from at_ group by threshold"""
)
def time_savings(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.time_saved(evaluate.ranked(ordered_runs_with_score(spark, d), F.round("score", 9).desc(), F.col("test_id")), "score", THRESHOLDS)
    return got.select("threshold", F.round("total_ms", 1).alias("total_ms"), F.round("saved_ms", 1).alias("saved_ms"), F.round("saved_share", 6).alias("saved_share"))


def ordered_runs_with_score(spark: SparkSession, d: str) -> DataFrame:
    carry = ("id", "repo", "job_sequence", "test_id", "failed", "duration_ms")
    return history.test_history(timed_runs(spark, d), carry).withColumn("score", F.lit(0.01) + F.greatest(F.col("failure_rate_90d"), F.lit(0.0)))


@query(
    with_(CTE_RUNS, CTE_HISTORY)
    + f""", tests as (select repo, test_id, count(*) n, round(avg(duration_variance), 6) v, coalesce({sql_corr('failure_rate_7d', 'failure_rate_30d')}, 0.0) agreement, avg(failure_rate_30d) rate from history group by 1, 2 having count(*) >= 20),
  scored as (select *, percent_rank() over (partition by repo order by v) * (1 - agreement) score from tests)
  select repo, test_id, n runs, round(score, 5) score, score > 0.7 and rate > 0.05 and rate < 0.5 flagged from scored"""
)
def flaky_score(spark: SparkSession, d: str) -> DataFrame:
    past = history.test_history(timed_runs(spark, d), ("repo", "test_id"))
    return evaluate.flaky_scores(past).select("repo", "test_id", "runs", F.round("score", 5).alias("score"), "flagged")


SQL_PSI = (
    WITH_MATRIX
    + ", sides as (select *, case when job_sequence <= cast(floor(0.8::double * max(job_sequence) over (partition by repo)) as bigint) then 'e' else 'a' end side from matrix), long_ as ("
    + " union all ".join(f"select '{c}' feature, {c}::double v, side from sides" for c in NUMERIC)
    + """), span as (select feature, min(v) filter (side = 'e') lo, max(v) filter (side = 'e') hi from long_ group by 1),
  bins as (select l.feature, side, case when hi > lo then greatest(0, least(9, floor((v - lo) / (hi - lo) * 10))) else 0 end b from long_ l join span s using (feature)),
  shares as (select feature, b, count(*) filter (side = 'e') e, count(*) filter (side = 'a') a from bins group by 1, 2),
  parts as (select feature, greatest(e / sum(e) over (partition by feature)::double, 0.0001) e, greatest(a / sum(a) over (partition by feature)::double, 0.0001) a from shares),
  index_ as (select feature, sum((a - e) * ln(a / e)) psi from parts group by feature)"""
)


def drift_indices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stability index of each feature between the first four fifths of the jobs and the rest, and the matrix."""
    rows = stored(split.split_sides(matrix_of(spark, d)).select("side", "label", *NUMERIC), "sides")
    return evaluate.psi(rows.where("side = 'train'"), rows.where("side = 'test'"), NUMERIC), rows


@query(SQL_PSI + " select feature, round(psi, 6) psi from index_")
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    return drift_indices(spark, d)[0].select("feature", F.round("psi", 6).alias("psi"))


@query(
    SQL_PSI
    + ", tied as ("
    + " union all ".join(f"select '{c}' feature, round(abs({sql_corr(c, 'label')}), 6) correlation from matrix" for c in NUMERIC)
    + "), top_ as (select feature from tied where correlation is not null order by correlation desc, feature limit 10) select count(*) features, round(avg(psi), 6) mean_psi, avg(psi) > 0.2 drifted from index_ join top_ using (feature)"
)
def drift_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ten features most tied to the label have drifted."""
    indices, rows = drift_indices(spark, d)
    got = evaluate.drift_verdict(indices, top_features(rows, 10))
    return got.select("features", F.round("mean_psi", 6).alias("mean_psi"), "drifted")


@query(with_(CTE_RUNS) + """, aged as (select *, row_number() over (partition by repo, test_id order by job_sequence desc) - 1 age from runs) select repo, test_id, round(sum(failed * 0.8 * pow(0.2, age)), 9) priority from aged group by 1, 2""")
def ema_priority(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ema_priority(runs_of(spark, d, "failed")).select("repo", "test_id", F.round("priority", 9).alias("priority"))


@query()
def apfd_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.apfd(ranks(spark, d, "mrf")).where("faults > 0").withColumn("key", F.concat_ws("|", "repo", "job_sequence"))
    return evaluate.bootstrap_interval(rows, "apfd", "key")


@query()
def order_difference(spark: SparkSession, d: str) -> DataFrame:
    keys = list(evaluate.JOB)
    a = evaluate.apfd(ranks(spark, d, "mrf")).where("faults > 0").select(*keys, F.col("apfd").alias("a"))
    b = evaluate.apfd(ranks(spark, d, "random")).where("faults > 0").select(*keys, F.col("apfd").alias("b"))
    return evaluate.paired_difference(a.join(b, keys), "a", "b")


@query(with_(CTE_RUNS) + """select repo, cast(floor("timestamp" / 86400) as bigint) day_no, count(distinct job_id) builds, count(*) runs, cast(sum(failed) as bigint) failed, round(sum(failed) / count(*)::double, 6) rate, round(sum(coalesce(duration_ms, 0.0)), 1) duration_ms from runs where "timestamp" is not null group by all""")
def daily_dashboard(spark: SparkSession, d: str) -> DataFrame:
    runs = ingest.first_rows(table(spark, d, "test_runs")).where("timestamp is not null").withColumn("day_no", F.floor(F.col("timestamp") / 86400))
    got = runs.groupBy("repo", "day_no", "job_id").agg(F.count("*").alias("runs"), F.sum("failed").alias("failed"), F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms")).groupBy("repo", "day_no").agg(F.count("*").alias("builds"), F.sum("runs").alias("runs"), F.sum("failed").alias("failed"), F.sum("duration_ms").alias("duration_ms"))
    return got.select("repo", "day_no", "builds", "runs", "failed", F.round(F.col("failed") / F.col("runs"), 6).alias("rate"), F.round("duration_ms", 1).alias("duration_ms"))


SQL_DASHBOARD = SQL["daily_dashboard"]
TREND_DAYS = 30


@query(f"select * from ({SQL_DASHBOARD}) q where day_no > (select max(day_no) from ({SQL_DASHBOARD}) x where x.repo = q.repo) - {TREND_DAYS}")
def trend_30d(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's days of each repo's last 30."""
    days = stored(daily_dashboard(spark, d), "days")
    last = days.groupBy("repo").agg(F.max("day_no").alias("_last"))
    return days.join(last, "repo").where(F.col("day_no") > F.col("_last") - TREND_DAYS).drop("_last")


@query(f"select cast(sum(builds) as bigint) builds, cast(sum(runs) as bigint) runs, cast(sum(failed) as bigint) failed, round(sum(failed) / sum(runs)::double, 6) rate, count(distinct repo) repos, count(distinct day_no) as days from ({SQL_DASHBOARD})")
def kpis(spark: SparkSession, d: str) -> DataFrame:
    """One row over all repos and days. A build that runs over two days counts on each."""
    total = lambda c: F.sum(c).alias(c)
    got = daily_dashboard(spark, d).agg(total("builds"), total("runs"), total("failed"), F.count_distinct("repo").alias("repos"), F.count_distinct("day_no").alias("days"))
    return got.select("builds", "runs", "failed", F.round(F.try_divide(F.col("failed").cast("double"), F.col("runs")), 6).alias("rate"), "repos", "days")


# Streaming


@query(f"""select repo, cast(floor(ts / 86400) as bigint) day_no, count(*) runs, cast(sum(cast({FAILED} as int)) as bigint) failed from (select *, {USABLE_TS} ts from test_runs) where ts is not null group by 1, 2""")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return collector.latest(collector.daily_counts(collector.stream_table(spark, f"{d}/test_runs.parquet")), "daily")


@query(with_(CTE_RUNS) + "select id, repo, test_id, failed from runs order by md5('42|' || cast(id as varchar)), id limit 1000")
def sampled_runs(spark: SparkSession, d: str) -> DataFrame:
    """A thousand runs at random: the sampling operator."""
    return pipeline.sample(ingest.first_rows(table(spark, d, "test_runs")).select("id", "repo", "test_id", "failed"), 1000, "id")


@query()
def learned_order(spark: SparkSession, d: str) -> DataFrame:
    """Mean APFD per repo of the last fifth of its jobs, ordered by a forest trained on the jobs before."""
    sides = stored(split.split_sides(matrix_of(spark, d)), "sides")
    return models.held_out_apfd(sides.where("side = 'train'"), sides.where("side = 'test'"), NUMERIC)
