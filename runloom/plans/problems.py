"""Queries of the general data-processing operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.commits import known_commits, short_names
from runloom.functions.keys import NO_SHA, epoch_s, failed, is_sha, is_short_sha, job_number, reference, trimmed, usable_before, usable_duration, usable_sequence, usable_timestamp
from runloom.functions.runs import distinct_runs
from runloom.functions.sql import REF, RUNS, USABLE_MS, USABLE_TS
from runloom.operators import asof, impute, orphans, rolling
from runloom.session import stored
from runloom.sources import csv_rejects
from runloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rolling_frame(spark: SparkSession, d: str) -> DataFrame:
    runs = distinct_runs(table(spark, d, "test_runs"), ts=usable_timestamp(), failed=failed(), duration=usable_duration())
    daily = rolling.daily_runs(runs.where("ts is not null").select("test_id", rolling.day_of(F.col("ts")).alias("day_no"), "failed", "duration"))
    return rolling.trailing_totals(daily, "test_id", "day_no", ["runs", "failed"], (7, 30), maxima=["duration"])


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling_frame(spark, d).where(~F.col("active") & (F.col("failed_7d") > 0)).select("test_id", "day_no")


@query
def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.col(c).cast("bigint").alias(c) for c in ("runs", "failed", "runs_7d", "failed_7d", "runs_30d", "failed_30d")]
    means = [F.round(c, 6).alias(c) for c in ("runs_avg_7d", "failed_avg_7d", "runs_avg_30d", "failed_avg_30d")]
    longest = [F.round(c, 3).alias(c) for c in ("duration_max_7d", "duration_max_30d")]
    return rolling_frame(spark, d).select("test_id", "day_no", *counts, *means, *longest)


SQL_DAYS = f"""with {RUNS}, daily as (
  select test_id, cast(floor(ts.v / 86400) as bigint) day_no, count(*) runs, count(*) filter (failed) failed, max(ms.v) longest
  from runs where ts.v is not null group by 1, 2),
span as (select test_id, unnest(range(min(day_no), max(day_no) + 1)) day_no from daily group by 1),
dense as (select s.test_id, s.day_no, coalesce(d.runs, 0) runs, coalesce(d.failed, 0) failed, d.longest from span s left join daily d using (test_id, day_no)),
rolled as (select test_id, day_no, runs, failed,
  sum(runs) over w7 runs_7d, sum(failed) over w7 failed_7d, max(longest) over w7 max7,
  sum(runs) over w30 runs_30d, sum(failed) over w30 failed_30d, max(longest) over w30 max30 from dense
  window w7 as (partition by test_id order by day_no rows 6 preceding), w30 as (partition by test_id order by day_no rows 29 preceding))"""
SQL["p3_found"] = SQL_DAYS + " select test_id, day_no from rolled where runs = 0 and failed_7d > 0"
SQL["p3_rolling"] = SQL_DAYS + """ select test_id, day_no, runs, failed, cast(runs_7d as bigint) runs_7d, cast(failed_7d as bigint) failed_7d,
  cast(runs_30d as bigint) runs_30d, cast(failed_30d as bigint) failed_30d, round(runs_7d / 7.0::double, 6) runs_avg_7d, round(failed_7d / 7.0::double, 6) failed_avg_7d,
  round(runs_30d / 30.0::double, 6) runs_avg_30d, round(failed_30d / 30.0::double, 6) failed_avg_30d, round(max7::double, 3) duration_max_7d, round(max30::double, 3) duration_max_30d from rolled"""


def commit_demand(spark: SparkSession, d: str) -> DataFrame:
    refs = [orphans.references(table(spark, d, t), t) for t in ("test_runs", "file_changes")]
    return stored(orphans.demand(refs[0].unionByName(refs[1])), "references")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(commit_demand(spark, d), table(spark, d, "commits"))
    return orphans.orphan_rows(found)


@query
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    refs = commit_demand(spark, d)
    return orphans.orphan_report(refs, orphans.orphan_references(refs, table(spark, d, "commits")))


SQL_ORPHANS = f"""with refs as (
  select 'test_runs' src, id, repo, {REF} ref, loaded_at from test_runs union all
  select 'file_changes', id, repo, {REF}, loaded_at from file_changes),
held as (select distinct repo, {REF} sha, loaded_at, deleted_at from commits),
kinds as (select *, case when regexp_full_match(ref, '[0-9a-f]{{40}}') and ref <> repeat('0', 40) then ref when regexp_full_match(ref, '[0-9a-f]{{7,39}}') then left(ref, 7) end as key from refs where ref is not null),
seen as (
  select k.src, k.id from kinds k join held h on k.repo = h.repo and k.key = h.sha where h.loaded_at <= k.loaded_at and (h.deleted_at is null or h.deleted_at > k.loaded_at)
  union select k.src, k.id from kinds k join held h on k.repo = h.repo and k.key = left(h.sha, 7) and starts_with(h.sha, k.ref)
  where h.loaded_at <= k.loaded_at and (h.deleted_at is null or h.deleted_at > k.loaded_at)),
found as (select src, strftime(loaded_at, '%Y-%m') period, id from kinds where (src, id) not in (select src, id from seen))"""
SQL["p4_found"] = SQL_ORPHANS + " select src, period, id from found"
SQL["p4_report"] = SQL_ORPHANS + """ select k.src, strftime(k.loaded_at, '%Y-%m') period, count(*) refs, count(f.id) orphans
  from kinds k left join found f on k.src = f.src and k.id = f.id group by 1, 2"""


ATTRIBUTES = ("owner_team", "tier", "quarantined", "timeout_s", "version_id")


def attributes_at_event(spark: SparkSession, d: str, attributes: tuple[str, ...]) -> DataFrame:
    tables = [table(spark, d, t) for t in ("test_runs", "commits", "test_owners", "shared_test_owners")]
    return asof.run_attributes(*tables, attributes)


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return attributes_at_event(spark, d, ATTRIBUTES).where("version_id is not null").select("id", "version_id")


@query
def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    return attributes_at_event(spark, d, ATTRIBUTES).select("id", "t", *ATTRIBUTES)


SQL_AS_OF = f"""with rows_ as (select id, repo, test_id, {USABLE_TS} ts, {REF} ref from test_runs),
known as (select repo, {REF} sha, min(committed_ts) committed_ts from commits group by 1, 2),
times as (
  select id, repo, test_id, ts t from rows_ where ts is not null union all
  select r.id, r.repo, r.test_id, min(k.committed_ts) from rows_ r join known k on r.repo = k.repo and left(r.ref, 7) = left(k.sha, 7) and starts_with(k.sha, r.ref)
  where r.ts is null and regexp_full_match(r.ref, '[0-9a-f]{{7,40}}') and r.ref <> repeat('0', 40) group by all),
versions as (
  select repo, test_id, version_id, owner_team, tier, quarantined, timeout_s, valid_from, coalesce(known_at, valid_from) known_at from test_owners union all
  select null, test_id, version_id, owner_team, tier, quarantined, timeout_s, valid_from, coalesce(known_at, valid_from) from shared_test_owners),
found as (
  select t.id, arg_max(struct_pack(version_id := v.version_id, owner_team := v.owner_team, tier := v.tier, quarantined := v.quarantined, timeout_s := v.timeout_s),
    (v.valid_from, v.known_at, v.version_id)) v
  from times t join versions v on t.test_id = v.test_id and (v.repo is null or v.repo = t.repo) and v.valid_from <= make_timestamp(t.t * 1000000) and v.known_at <= make_timestamp(t.t * 1000000) group by t.id)"""
SQL["p6_found"] = SQL_AS_OF + " select id, v.version_id from found"
SQL["p6_attributes"] = SQL_AS_OF + " select t.id, t.t, v.owner_team, v.tier, v.quarantined, v.timeout_s, v.version_id from times t left join found f on t.id = f.id"


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return csv_rejects.load_results(table(spark, d, "raw_results")).where("reason is not null").select("line_id", "reason")


@query
def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = csv_rejects.load_results(table(spark, d, "raw_results")).where("reason is null")
    return loaded.select("line_id", "job_id", "test_id", "test_index", F.round("duration_ms", 6).alias("duration_ms"), "run_count", "failures", "errors", "skipped")


SQL_LINES = r"""with cut as (select line_id, raw_line, regexp_extract_all(',' || raw_line, ',("([^"]|"")*"|[^",]*)', 1) f from raw_results),
fields as (select line_id, regexp_full_match(raw_line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') sound,
  [trim(case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end, E' \t\r\n\x0b\x0c\x0b') for x in f] f from cut),
judged as (select line_id, f, case when not sound then 'quoting' when len(f) <> 8 then 'columns'
  when not regexp_full_match(f[1], '[0-9]{1,18}') or f[2] = '' or not (f[4] = '' or (regexp_full_match(f[4], '([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and isfinite(try_cast(f[4] as double))))
    or not regexp_full_match(f[3] || f[5] || f[6] || f[7] || f[8], '[0-9]*') then 'value' end reason from fields),
lines as (select * from judged where not (len(f) = 8 and ltrim(f[1], chr(65279)) = 'travisJobId' and f[2] = 'testName' and f[8] = 'skipped'))"""
SQL["p7_found"] = SQL_LINES + " select line_id, reason from lines where reason is not null"
SQL["p7_loaded"] = SQL_LINES + """ select line_id, cast(f[1] as bigint) job_id, f[2] test_id, cast(nullif(f[3], '') as bigint) test_index, round(1000 * cast(nullif(f[4], '') as double), 6) duration_ms,
  cast(nullif(f[5], '') as bigint) run_count, cast(nullif(f[6], '') as bigint) failures, cast(nullif(f[7], '') as bigint) errors, cast(nullif(f[8], '') as bigint) skipped from lines where reason is null"""


FILLED = ("timestamp", "job_sequence", "duration_ms")


def fillable_runs(spark: SparkSession, d: str) -> DataFrame:
    """The rows of test_runs with null for what is missing. ``commit``: the bytes of the full sha; a short reference goes by its repo and text,
    which ``short`` has too. ``season``: a number for the repo in thirty days of loading."""
    ref, sha = reference(), F.col("_sha")
    # most references are a sha as it stands, decoded once here; the others take the whole normal form
    rows = table(spark, d, "test_runs").withColumns({"loaded": epoch_s("loaded_at"), "_sha": F.when(F.length("commit_sha") == 40, F.unhex("commit_sha"))})
    rows = rows.withColumn("short", F.when(sha.isNull() & is_short_sha(ref), F.concat_ws(BY, "repo", ref)))
    other = F.when(F.col("short").isNotNull(), F.col("short").cast("binary")).when(is_sha(ref), F.unhex(ref))
    return rows.select(
        "id",
        job_number().alias("job"),
        usable_before(F.col("loaded")).alias("timestamp"),
        usable_sequence().alias("job_sequence"),
        usable_duration().alias("duration_ms"),
        "loaded",
        "test_id",
        F.upper(trimmed("outcome")).alias("outcome"),
        F.when(sha.isNull(), other).when(sha != F.unhex(F.lit(NO_SHA)), sha).alias("commit"),
        "short",
        F.xxhash64("repo", F.floor(F.col("loaded") / (30 * 86400))).alias("season"),
    )


BY = "|"


def named_by_short(commits: DataFrame):
    """From the short names of commits in ``fillable_runs`` to the full sha of those that begin one commit of their repo only."""

    def names(of: DataFrame) -> DataFrame:
        short = of.select(F.substring_index("commit", BY, 1).alias("repo"), F.substring_index("commit", BY, -1).alias("ref")).where(F.length("repo") > 0)
        found = short_names(short, known_commits(commits)).groupBy("repo", "ref").agg(F.min("sha").alias("_of"), F.count("*").alias("n")).where("n = 1")
        return found.select(F.concat_ws(BY, "repo", "ref").cast("binary").alias("commit"), F.unhex("_of").alias("_of"))

    return names


def fill_runs(rows: DataFrame, commits: DataFrame) -> DataFrame:
    times = ["timestamp", "job_sequence"]
    least, aliases = {"job": times, "commit": times}, {"commit": ("short", named_by_short(commits))}
    return impute.fill_missing(rows, "id", FILLED, ["loaded"], ["outcome"], least, {"season": times}, {"test_id": ["duration_ms"]}, aliases)


def filled_runs(spark: SparkSession, d: str) -> DataFrame:
    return fill_runs(fillable_runs(spark, d), table(spark, d, "commits"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    marks = [F.when(F.col(f"{f}_filled"), f) for f in FILLED]
    return filled_runs(spark, d).select("id", F.explode(F.array_compact(F.array(*marks))).alias("field"))


@query
def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    whole = [F.round(f).cast("bigint").alias(f) for f in ("timestamp", "job_sequence")]
    return filled_runs(spark, d).select("id", *whole, F.round("duration_ms", 3).alias("duration_ms"), *[f"{f}_filled" for f in FILLED])


SQL["p5_found"] = f"""select id, 'timestamp' field from test_runs where ({USABLE_TS}) is null union all
  select id, 'job_sequence' from test_runs where coalesce(job_sequence < 1 or job_sequence >= 100000000, true) union all
  select id, 'duration_ms' from test_runs where ({USABLE_MS}) is null"""
