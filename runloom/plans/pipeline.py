"""From the tables to checked feature matrices: ``python -m runloom.plans.pipeline TABLES OUT [--force] [--repos NAME ...] [--summary FILE]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators import ingest, matrix, quality, split
from runloom.session import clear, stored
from runloom.sources.projects import list_files, markdown_table, read_selected, report_rows, wanted_projects, write_once
from runloom.sources.tables import table


def build(spark: SparkSession, tables: str, repo: str | None = None) -> DataFrame:
    """The feature matrix of one repo, or of all; the filter on repo reaches the scans."""
    of = lambda name: table(spark, tables, name).where(F.col("repo") == repo) if repo else table(spark, tables, name)
    runs = stored(ingest.sequenced_runs(of("test_runs")), "runs")
    return matrix.feature_matrix(runs, ingest.commit_rows(of("commits")), stored(ingest.changed_files(of("file_changes")), "files"))


def check_coverage(spark: SparkSession, tables: str, repo: str | None, least: float) -> None:
    """The gate before anything is built: enough commits and rows of each repo must have a time."""
    of = lambda name: table(spark, tables, name).where(F.col("repo") == repo) if repo else table(spark, tables, name)
    merged = ingest.merged_times(ingest.first_rows(of("test_runs"), "commit_sha", "timestamp"), ingest.commit_rows(of("commits")))
    quality.require_coverage(ingest.time_coverage(merged), least)


def run(spark: SparkSession, tables: str, out: str, repo: str | None = None, force: bool = False, strict: bool = False, coverage: float | None = None) -> DataFrame | None:
    """Builds, checks and only then writes the matrix; does nothing where it is already there, unless forced. strict: also
    refuses a matrix in which times fall from one job to the next; rebuilt jobs make them do so in honest data. coverage: the least percentage of commits and rows with a time.

    Returns (repo, label, rows).
    """
    target = f"{out}/{repo or 'all'}_features.parquet"
    if list_files(spark, f"{target}/_SUCCESS") and not force:
        return None
    if coverage is not None:
        check_coverage(spark, tables, repo, coverage)
    features = stored(build(spark, tables, repo), "matrix")
    quality.require_no_nulls(features)
    # The source baselines name repos by the names of known projects; those that are absent here check nothing.
    quality.validate_features(features, quality.SOURCE_BASELINES, in_order=strict)
    write_once(features.repartition("repo"), target, force=True)
    return features.groupBy("repo", "label").agg(F.count("*").alias("rows"))


def assemble(spark: SparkSession, paths: list[str], out: str, strict: bool = False) -> DataFrame:
    """Unites matrices of several repos, checks and writes them."""
    full = split.union_projects([spark.read.parquet(p) for p in paths])
    quality.validate_features(full, quality.SOURCE_BASELINES, in_order=strict)
    full.write.mode("overwrite").parquet(out)
    return full


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows at random, the same ones each time: those whose key has the least hash with the seed."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("--repos", nargs="*", default=[], help="names, parted by blanks or commas; in this order, each once")
    p.add_argument("--summary", help="a Markdown table of projects: those marked SELECTED are taken where no names are given")
    p.add_argument("--force", action="store_true")
    p.add_argument("--strict", action="store_true", help="refuse a matrix whose times fall from one job to the next")
    p.add_argument("--coverage", type=float, help="least percentage of commits and rows with a time")
    p.add_argument("--least-projects", type=int, default=0, help="fail where fewer projects are asked for")
    a = p.parse_args()
    spark = SparkSession.builder.appName("runloom").getOrCreate()
    selected = [r["project"] for r in read_selected(spark, a.summary).collect()] if a.summary else []  # the lines of a report
    wanted = wanted_projects(a.repos, selected)
    if len(wanted) < a.least_projects:
        raise SystemExit(f"{len(wanted)} of at least {a.least_projects} projects")
    for repo in wanted or [None]:
        report = run(spark, a.tables, a.out, repo, a.force, a.strict, a.coverage)
        print(f"{repo or 'all'}: the matrix is there already" if report is None else f"{repo or 'all'}: written")
        if report is not None:
            print(markdown_table(report_rows(report, "repo", "label")))
    clear(spark)


if __name__ == "__main__":
    main()
