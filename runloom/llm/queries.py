"""Queries of the operators for language-model training data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.keys import usable_duration
from runloom.functions.runs import distinct_runs
from runloom.functions.sql import JOB, REF, RUNS
from runloom.llm import packing, spam, splits, tokenizer, topn
from runloom.session import stored
from runloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def query(f):
    QUERIES[f.__name__] = f
    return f


def linked_jobs(spark: SparkSession, d: str, jobs: DataFrame) -> DataFrame:
    return stored(splits.linked(splits.named_commits(jobs, table(spark, d, "commits"))), "labels")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_pairs(linked_jobs(spark, d, splits.numbered_jobs(table(spark, d, "test_runs"))))


@query
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    jobs = stored(splits.all_jobs(table(spark, d, "test_runs")), "jobs")
    return splits.assign_splits(jobs, linked_jobs(spark, d, jobs), SHARES)


SQL["p1_found"] = f"""with recursive named as (
  select distinct {JOB} job, repo, {REF} ref from test_runs where {JOB} is not null and {REF} is not null),
known as (select distinct repo, {REF} sha from commits),
pairs as (
  select distinct job, ref sha from named where regexp_full_match(ref, '[0-9a-f]{{40}}') and ref <> repeat('0', 40) union
  select n.job, k.sha from named n join known k on n.repo = k.repo and left(n.ref, 7) = left(k.sha, 7) and starts_with(k.sha, n.ref) where regexp_full_match(n.ref, '[0-9a-f]{{7,39}}')),
links as (select distinct a.job a, b.job b from pairs a join pairs b using (sha) where a.job <> b.job),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select distinct a as job_lo, b as job_hi from reach where a < b"""


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return longest_runs(spark, d).select("test_id", "id")


@query
def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return longest_runs(spark, d).select("test_id", "rank", "id", F.round("duration_ms", 3).alias("duration_ms"))


def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = distinct_runs(table(spark, d, "test_runs"), duration_ms=usable_duration())
    return topn.top_n(runs, "test_id", "duration_ms", "id", 5)


SQL_TOP = f"""with {RUNS},
ranked as (select test_id, row_number() over (partition by test_id order by ms.v desc, id) as "rank", id, ms.v ms from runs where ms.v is not null)"""
SQL["p2_found"] = SQL_TOP + ' select test_id, id from ranked where "rank" <= 5'
SQL["p2_top"] = SQL_TOP + ' select test_id, "rank", id, round(ms::double, 3) duration_ms from ranked where "rank" <= 5'


CAPACITY = 2048


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def packed_documents(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenizer.token_counts(table(spark, d, "documents")), "doc_id", "tokens", CAPACITY)


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lie in more than one container."""
    ends = packed_documents(spark, d).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return ends.where("first <> last").select("doc_id")


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed_documents(spark, d)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.judged_pages(table(spark, d, "documents")).where("is_spam").select("doc_id")


@query
def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    return spam.judged_pages(table(spark, d, "documents"))
