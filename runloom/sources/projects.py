"""The pipeline's files: result, mapping, patch and offender CSVs, summaries in Markdown, git logs, Java sources."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.keys import trimmed
from runloom.sources.csv_rejects import BYTE_ORDER_MARK, HEADER
from runloom.sources.tables import require_columns

NOT_MAIN = ("-patches.csv", "-pr.csv", "-offenders.csv")
REQUIRED = set(HEADER)
MOST_MISSING = 0.1


def bare(c: str):
    """Text without white space around it; null becomes empty."""
    return F.coalesce(trimmed(c), F.lit(""))


def whole_number(c: str):
    """A number cut to its whole part; blank or invalid text is 0."""
    return F.coalesce(trimmed(c).try_cast("double").try_cast("int"), F.lit(0))


def real_number(c: str):
    """A number, null where blank or invalid; NaN and infinities are invalid too."""
    n = trimmed(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text, a byte order mark stripped from the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')
    return df.toDF(*[c.lstrip(BYTE_ORDER_MARK).strip() for c in df.columns])


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted, from the file system the pattern names; only names and sizes are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().toString()) for f in found or [])


def find_main_csv(spark: SparkSession, folder: str) -> str | None:
    """``<folder name>.csv``, else the first CSV that isn't a patch, pull-request or offender file and has the required columns."""
    files = list_files(spark, f"{folder}/*.csv")
    exact = [f for f in files if PurePosixPath(f).name == f"{PurePosixPath(folder).name}.csv"]
    others = [f for f in files if not f.endswith(NOT_MAIN)]
    return next(iter(exact), None) or next((f for f in others if REQUIRED <= set(read_text_csv(spark, f).columns)), None)


def find_patches_csv(spark: SparkSession, folder: str) -> str | None:
    files = list_files(spark, f"{folder}/*-patches.csv")
    exact = [f for f in files if PurePosixPath(f).name == f"{PurePosixPath(folder).name}-patches.csv"]
    return next(iter(exact or files), None)


def project_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders named ``owner@project`` that have a main file, sorted."""
    return [f for f in list_files(spark, f"{root}/*@*") if find_main_csv(spark, f)]


def read_results(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """The result rows of one project in normal types. Raises ValueError if a required column is missing."""
    df = require_columns(read_text_csv(spark, path), REQUIRED, path)
    ms = real_number("duration") * 1000
    numbers = [whole_number(c).alias(n) for c, n in (("index", "test_index"), ("count", "run_count"), ("failures", "failures"), ("errors", "errors"), ("skipped", "skipped"))]
    return df.withColumn("line_id", F.monotonically_increasing_id()).select("line_id", F.lit(repo).alias("repo"), bare("travisJobId").alias("job_id"), bare("testName").alias("test_id"), ms.alias("duration_ms"), *numbers)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, commit_sha) from ``tr_job_id`` and ``git_commit_id``, else ``sha``; rows with a blank are skipped, the last row of a job wins."""
    df = read_text_csv(spark, path)
    sha = "git_commit_id" if "git_commit_id" in df.columns else "sha"
    if "tr_job_id" not in df.columns or sha not in df.columns:
        raise ValueError(f"{path}: needs tr_job_id and git_commit_id or sha")
    rows = df.select(bare("tr_job_id").alias("job_id"), bare(sha).alias("commit_sha"), F.monotonically_increasing_id().alias("_row")).where("job_id <> '' and commit_sha <> ''")
    return rows.groupBy("job_id").agg(F.max_by("commit_sha", "_row").alias("commit_sha"))


def read_patches(spark: SparkSession, path: str, repo: str) -> DataFrame:
    rows = read_text_csv(spark, path).select(F.lit(repo).alias("repo"), bare("sha").alias("commit_sha"), bare("name").alias("file_path"))
    return rows.where("commit_sha <> '' and file_path <> ''").dropDuplicates(["repo", "commit_sha", "file_path"])


def read_offenders(spark: SparkSession, path: str) -> DataFrame:
    """(job_id) without leading zeros; text that is no number is skipped."""
    return read_text_csv(spark, path).select(trimmed("tr_job_id").try_cast("bigint").cast("string").alias("job_id")).where("job_id is not null").distinct()


def dry_run(results: DataFrame, mapping: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """(rows, unmapped, null_durations, patch_rows) of what a load would read, with the rates of the middle two and whether
    one of them passes MOST_MISSING; an empty file has rates of 0."""
    rows = results.join(mapping, "job_id", "left")
    got = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("commit_sha").isNull()).alias("unmapped"), F.count_if(F.col("duration_ms").isNull()).alias("null_durations"))
    got = got.withColumn("patch_rows", F.lit(patches.count() if patches is not None else 0).cast("bigint"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("rows")), F.lit(0.0))
    got = got.withColumn("unmapped_rate", rate("unmapped")).withColumn("null_duration_rate", rate("null_durations"))
    return got.withColumn("warning", F.greatest("unmapped_rate", "null_duration_rate") > MOST_MISSING)


def load_totals(reports: DataFrame) -> DataFrame:
    """One row over the ``dry_run`` reports of several projects: sums, and the rates and warning of the whole."""
    counts = ["rows", "unmapped", "null_durations", "patch_rows"]
    got = reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("rows")), F.lit(0.0))
    got = got.withColumn("unmapped_rate", rate("unmapped")).withColumn("null_duration_rate", rate("null_durations"))
    return got.withColumn("warning", F.greatest("unmapped_rate", "null_duration_rate") > MOST_MISSING)


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """(project) of the rows of a Markdown table with at least five cells whose fifth is exactly SELECTED."""
    cells = F.transform(F.split(F.expr("trim(both '|' from trim(value))"), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).where(F.col("value").startswith("|")).select(cells.alias("c"))
    return rows.where((F.size("c") >= 5) & (F.col("c")[4] == "SELECTED")).select(F.col("c")[0].alias("project"))


def wanted_projects(named: Sequence[str], selected: Sequence[str] = ()) -> list[str]:
    """The projects named (several may share one argument, parted by commas or blanks), else the selected ones: in order, each once."""
    given = [p for argument in named for p in argument.replace(",", " ").split()]
    return list(dict.fromkeys(given or selected))


def report_rows(df: DataFrame, *order: str) -> DataFrame:
    """A report in a defined order: by ``order``, then by all its other columns; nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in dict.fromkeys([*order, *df.columns])])


def short_sha(c: str):
    return F.substring(c, 1, 8)


def percent(c: str):
    """A share as text such as 12.5%."""
    return F.format_string("%.1f%%", 100 * F.col(c).cast("double"))


def thousands(c: str):
    return F.format_number(F.col(c), 0)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report of few rows as a Markdown table; refuses frames of more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def read_git_log(spark: SparkSession, path: str, repo: str, needed: DataFrame | None = None, later: str | None = None) -> DataFrame:
    """(repo, commit_sha, committed_ts) from lines of sha and epoch second; other lines are skipped.

    ``needed`` (commit_sha): only these commits; ``later``: a second file of the same form, asked for those the first one lacks.
    """
    if later is not None:
        first, second = read_git_log(spark, path, repo, needed), read_git_log(spark, later, repo, needed)
        return first.unionByName(second.join(first.select("repo", "commit_sha"), ["repo", "commit_sha"], "left_anti"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.lit(repo).alias("repo"), parts[0].alias("commit_sha"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("committed_ts"))
    rows = rows.where("committed_ts is not null")
    if needed is not None:
        rows = rows.join(needed.select("commit_sha").distinct(), "commit_sha", "left_semi").select("repo", "commit_sha", "committed_ts")
    return rows.groupBy("repo", "commit_sha").agg(F.min("committed_ts").alias("committed_ts"))


def read_numstat(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, commit_sha, parent_no, added, deleted, path) from tab-separated lines of sha, added, deleted, path and, for
    merges, the number of the parent (absent: the first)."""
    p = F.split("value", "\t")
    parent = F.coalesce(F.try_element_at(p, F.lit(5)).try_cast("int"), F.lit(1))
    return spark.read.text(path).where(F.size(p) >= 4).select(F.lit(repo).alias("repo"), F.trim(p[0]).alias("commit_sha"), parent.alias("parent_no"), p[1].alias("added"), p[2].alias("deleted"), p[3].alias("path"))


def read_sources(spark: SparkSession, root: str, repo: str, revision: str | None = None) -> DataFrame:
    """(repo, revision, path, text) of the Java files under a folder: a work tree, or the export of one revision."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").text(root, wholetext=True)
    inside = F.expr(f"substring_index(_metadata.file_path, '{PurePosixPath(root).name}/', -1)")
    return df.select(F.lit(repo).alias("repo"), F.lit(revision).cast("string").alias("revision"), inside.alias("path"), F.col("value").alias("text"))


def sources_at(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, commit_sha, path, text) for each of ``wanted`` (repo, commit_sha, path): the text of that revision, else of the work tree (revision null)."""
    key = ["repo", "path"]
    old = sources.where("revision is not null").select(*key, F.col("revision").alias("commit_sha"), F.col("text").alias("_then"))
    now = sources.where("revision is null").select(*key, F.col("text").alias("_now"))
    got = wanted.join(old, [*key, "commit_sha"], "left").join(now, key, "left").withColumn("text", F.coalesce("_then", "_now"))
    return got.where(F.col("text").isNotNull()).select("repo", "commit_sha", "path", "text")


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes a table unless it is there already; whether it was written."""
    if list_files(df.sparkSession, f"{path}/_SUCCESS") and not force:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def read_test_reports(spark: SparkSession, path: str, repo: str, job_id: int) -> DataFrame:
    """Runs from Surefire XML reports: one row per class of a suite, a class failed if any of its cases did."""
    schema = "_name string, testcase array<struct<_classname: string, _name: string, _time: double, failure: array<string>, error: array<string>, skipped: array<string>>>"
    suites = spark.read.format("xml").option("rowTag", "testsuite").option("nullValue", "").schema(schema).load(path)
    case = suites.select(F.explode("testcase").alias("c")).select(F.col("c._classname").alias("test_id"), "c._time", *[F.col(f"c.{k}").isNotNull().alias(k) for k in ("failure", "error", "skipped")])
    per = case.groupBy("test_id").agg(F.sum("_time").alias("s"), F.count("*").alias("run_count"), *[F.count_if(k).alias(k) for k in ("failure", "error", "skipped")])
    outcome = F.when(F.col("failure") > 0, "FAIL").when(F.col("error") > 0, "ERROR").when(F.col("skipped") == F.col("run_count"), "SKIPPED").otherwise("PASS")
    return per.select(F.lit(repo).alias("repo"), F.lit(job_id).cast("bigint").alias("job_id"), "test_id", outcome.alias("outcome"), (F.col("s") * 1000).alias("duration_ms"), "run_count")
