"""References to commits that were not there when the referring row was loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.keys import is_sha, is_short_sha, reference

HEAVY_ROWS = 200_000  # most commits rows that are broadcast for the heavy keys
HEAVY_SHARE = 10_000  # a key is heavy with at least 1 / HEAVY_SHARE of all references: at most so many keys are
BLOCK = 1024  # ids of one key are gathered in arrays of at most so many


def references(table: DataFrame, name: str) -> DataFrame:
    """(src, repo, ref, loaded_at, id) of the rows with a reference."""
    ref = reference()
    return table.select(F.lit(name).alias("src"), "repo", ref.alias("ref"), "loaded_at", "id").where(F.col("ref").isNotNull())


def demand(refs: DataFrame) -> DataFrame:
    """References pre-aggregated per key, period and time of loading: (src, repo, ref, loaded_at, period, n, ids).

    The rows of a job are loaded together, so this is much smaller than the rows. ``ids`` holds at most BLOCK row
    ids: a hot key makes many rows here, not one large one.
    """
    block = F.floor(F.col("id") / BLOCK).alias("block")
    got = refs.groupBy("src", "repo", "ref", "loaded_at", block).agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    return got.withColumn("period", F.date_format("loaded_at", "yyyy-MM")).drop("block")


def orphan_references(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """The pre-aggregated references for which ``commits`` had no visible row: (src, period, repo, ref, n, ids).

    refs: ``demand``. commits: repo, commit_sha, loaded_at, deleted_at. A reference of 40 hex digits names that sha,
    one of 7 to 39 the commits of the repo whose sha begins with it, any other text none. A commits row is visible
    from loaded_at until deleted_at.

    Keys with a large share of the references (known from the pre-aggregated counts, at most HEAVY_SHARE of them)
    are checked against broadcast commits rows of just these keys; the others take a shuffled anti-join; both
    results are united. A null repo names no commit, a null loaded_at sees none: both are orphans. Repeated
    commits rows change nothing.
    """
    spark = refs.sparkSession
    ref = F.col("ref")
    kind = F.when(is_sha(ref), ref).when(is_short_sha(ref), F.substring(ref, 1, 7))
    refs = refs.withColumn("key", kind)
    sha = reference()
    held = commits.select(F.col("repo").alias("c_repo"), sha.alias("sha"), F.col("loaded_at").alias("c_from"), F.col("deleted_at").alias("c_to")).where(is_sha(F.col("sha")) & F.col("c_repo").isNotNull()).distinct()
    sees = (F.col("c_from") <= F.col("loaded_at")) & (F.col("c_to").isNull() | (F.col("c_to") > F.col("loaded_at")))

    counts = refs.groupBy("repo", "key").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = [(r.repo, r.key) for r in counts.where((F.col("n") >= total // HEAVY_SHARE + 1) & F.col("repo").isNotNull() & F.col("key").isNotNull()).collect()]

    def check(part: DataFrame, shas: DataFrame, small: bool) -> list[DataFrame]:
        """Full shas and short ones apart: each is an equi-join."""
        full = shas.withColumn("c_key", F.col("sha"))
        short = shas.withColumn("c_key", F.substring("sha", 1, 7))
        on = (F.col("repo") == F.col("c_repo")) & (F.col("key") == F.col("c_key")) & sees
        hint = F.broadcast if small else (lambda x: x)
        is_short = F.length("ref") < 40
        return [
            part.where(~is_short).join(hint(full), on, "left_anti"),
            part.where(is_short).join(hint(short), on & F.col("sha").startswith(ref), "left_anti"),
        ]

    nameless = refs.where(F.col("key").isNull())
    named = refs.where(F.col("key").isNotNull())
    if heavy:
        keys = F.broadcast(spark.createDataFrame(heavy, "h_repo string, h_key string"))
        same = (F.col("repo") == F.col("h_repo")) & (F.col("key") == F.col("h_key"))
        of_heavy = held.join(keys, (F.col("c_repo") == F.col("h_repo")) & ((F.col("sha") == F.col("h_key")) | (F.substring("sha", 1, 7) == F.col("h_key"))), "left_semi")
        small = of_heavy.limit(HEAVY_ROWS + 1).count() <= HEAVY_ROWS  # else adaptive execution splits the hot keys of a sort-merge join
        parts = check(named.join(keys, same, "left_semi"), of_heavy, small) + check(named.join(keys, same, "left_anti"), held, False)
    else:
        parts = check(named, held, False)
    columns = ["src", "period", "repo", "ref", "n", "ids"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in [nameless, *parts]])


def orphan_rows(orphans: DataFrame) -> DataFrame:
    return orphans.select("src", "period", F.explode("ids").alias("id"))


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans per table and month."""
    found = orphans.groupBy("src", "period").agg(F.sum("n").alias("orphans"))
    return refs.groupBy("src", "period").agg(F.sum("n").alias("refs")).join(found, ["src", "period"], "left").select("src", "period", "refs", F.coalesce("orphans", F.lit(0)).alias("orphans"))
