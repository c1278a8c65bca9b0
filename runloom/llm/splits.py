"""Train, validation and test splits that keep linked records together.

Linked jobs are found with a distributed union-find: every task of the scan joins its own jobs and commits into a
local forest and passes on one row per commit and local tree; trees of different tasks that name the same commit are
then linked. The forests are merged level by level, each level in a fraction of the tasks of the one before: a task joins
the trees whose roots it has, then roots that one node has in several tasks are linked, so that a level ends with
stars. There are never fewer tasks than the links left need, and levels end when nothing is left to join; none of it depends
on the links fitting one task or the driver. Whole groups are then assigned largest first to the split furthest below
its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.commits import known_commits, short_names
from runloom.functions.keys import is_sha, is_short_sha, job_number, reference, usable_sequence
from runloom.llm.ranks import numbered
from runloom.session import stored

TASK_LINKS = 2_000_000  # that one task holds
PLAN_ROWS = 1_000_000  # of the plan that are broadcast; nearly all groups have size 1, so a join by size is uneven
FAN = 4  # a level has a fourth of the tasks of the one before


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of n nodes under the links a-b: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(links: pd.DataFrame) -> pd.DataFrame:
    """(node, root) for the nodes of the links (node, root) that aren't their component's least."""
    ids, at = np.unique(np.concatenate([links["node"].to_numpy(), links["root"].to_numpy()]), return_inverse=True)
    root = roots(at[: len(links)], at[len(links) :], len(ids))
    moved = root != np.arange(len(ids))
    return pd.DataFrame({"node": ids[moved], "root": ids[root[moved]]})


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows > TASK_LINKS:  # a forest has fewer links than nodes: what is held stays in proportion to these
            held = [forest(pd.concat(held))]
            rows = len(held[0])
    if held:
        yield forest(pd.concat(held))


def _scan_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of one task's (job, sha) rows: (sha, node = root) for each commit, (null, node, root) for each linked job."""
    seen = []
    for pdf in batches:
        seen.append(pdf.drop_duplicates())
    if not seen:
        return
    rows = pd.concat(seen).drop_duplicates()
    jobs, job = np.unique(rows["job"].to_numpy(), return_inverse=True)
    sha, shas = pd.factorize(rows["sha"])
    root = roots(job, len(jobs) + sha, len(jobs) + len(shas))
    of_sha, of_job = jobs[root[len(jobs) :]], root[: len(jobs)]
    moved = of_job != np.arange(len(jobs))
    yield pd.DataFrame({"sha": shas, "node": of_sha, "root": of_sha})
    yield pd.DataFrame({"sha": None, "node": jobs[moved], "root": jobs[of_job[moved]]})


def numbered_jobs(test_runs: DataFrame) -> DataFrame:
    """(job, repo, ref) of the rows whose job_id is a number."""
    return test_runs.select(job_number().alias("job"), "repo", reference().alias("ref")).where(F.col("job").isNotNull())


def all_jobs(test_runs: DataFrame) -> DataFrame:
    """(job, repo, ref) of every row. A row whose job_id is no number belongs to the least job number that the repo's other rows
    give its job_sequence, else to a job of that repo and sequence, else to one of its own; the last two have negative numbers."""
    rows = test_runs.select("id", job_number().alias("number"), "repo", usable_sequence().alias("sequence"), reference().alias("ref"))
    told, rest = rows.where(F.col("number").isNotNull()), rows.where(F.col("number").isNull())
    places = rest.where(F.col("sequence").isNotNull() & F.col("repo").isNotNull()).select("repo", "sequence").distinct()
    known = told.join(places, ["repo", "sequence"], "left_semi").groupBy("repo", "sequence").agg(F.min("number").alias("known"))
    other = F.when(F.col("sequence").isNotNull() & F.col("repo").isNotNull(), -F.abs(F.xxhash64("repo", "sequence")) - 1).otherwise(-F.col("id") - 1)
    rest = rest.join(known, ["repo", "sequence"], "left").select(F.coalesce("known", other).alias("job"), "repo", "ref")
    return told.select(F.col("number").alias("job"), "repo", "ref").unionByName(rest)


def named_commits(jobs: DataFrame, commits: DataFrame) -> DataFrame:
    """(job, sha) for the rows of ``jobs`` (job, repo, ref) that name a commit: 40 digits as they stand, fewer as the commit of the repo they begin."""
    full = jobs.where(is_sha(F.col("ref"))).select("job", F.unhex("ref").alias("sha"))
    short = jobs.where(is_short_sha(F.col("ref"))).distinct()
    names = short_names(short, known_commits(commits)).select("repo", "ref", F.unhex("sha").alias("sha"))
    return full.unionByName(short.join(names, ["repo", "ref"]).select("job", "sha"))


def linked(pairs: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root): each job with its group's least job, for groups of more than one; ``pairs``: job bigint, sha binary.

    Nulls must have been left out; repeated rows change nothing; no rows give no groups. A commit named by a third of
    all rows reaches the next step as one row per task.
    """
    local = stored(pairs.mapInPandas(_scan_forest, "sha binary, node bigint, root bigint"), "forests")
    of_sha = local.where(F.col("sha").isNotNull())
    least = of_sha.groupBy("sha").agg(F.min("root").alias("least"))
    joined = of_sha.join(least, "sha").where("node <> least").select("node", F.col("least").alias("root"))
    links = stored(local.where(F.col("sha").isNull()).select("node", "root").unionByName(joined), "links")
    tasks = max(FAN, pairs.sparkSession.sparkContext.defaultParallelism)
    while True:
        tasks = max(tasks // FAN, -(-links.count() // task_links), 1)
        merged = links.repartition(tasks, "root").mapInPandas(_forests, "node bigint, root bigint")
        if tasks == 1:  # one forest: nothing outside it
            return merged
        links, changed = star_round(stored(merged, "level"))
        if not changed:
            return links


def star_round(links: DataFrame) -> tuple[DataFrame, bool]:
    """One large-star and small-star contraction; whether anything changed. Each minimum is combined before its shuffle,
    and joins on a hot root are split by adaptive execution."""
    both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
    large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node <> root").distinct()
    up = large.groupBy("node").agg(F.min("root").alias("least"))
    small = large.join(up, "node").select(F.explode(F.array("node", "root")).alias("node"), F.col("least").alias("root")).where("node <> root").distinct()
    out = stored(small, "links")
    several = out.groupBy("node").count().where("count > 1").limit(1).count()
    nested = out.join(out.select(F.col("node").alias("n2")).distinct(), F.col("root") == F.col("n2"), "left_semi").limit(1).count()
    return out, bool(several or nested)


def groups(labels: DataFrame) -> DataFrame:
    """The labels with the roots themselves: every member of a group of more than one."""
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())


def group_pairs(labels: DataFrame) -> DataFrame:
    """(job_lo, job_hi): all pairs of different jobs of a group."""
    members = stored(groups(labels), "members")
    lo, hi = members.select(F.col("node").alias("job_lo"), "root"), members.select(F.col("node").alias("job_hi"), "root")
    return lo.join(hi, "root").where("job_lo < job_hi").select("job_lo", "job_hi")


def allot(sizes: Sequence[tuple[int, int]], shares: Sequence[float]) -> list[tuple[int, list[int]]]:
    """For each (size, number of groups), largest first, how many groups each split gets.

    The greedy rule, each group to the split furthest below its target (ties: the first), done for all groups of one
    size at once: they go where they level the splits' deficits, the last few one by one.
    """
    total = sum(s * c for s, c in sizes)
    short = [share * total for share in shares]
    out = []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        order = sorted(short, reverse=True)
        for k in range(1, len(order) + 1):  # the level to which the k neediest splits come down
            level = (sum(order[:k]) - size * count) / k
            if k == len(order) or level >= order[k]:
                break
        left = count
        for s, need in enumerate(short):
            got[s] = min(left, max(0, int((need - level) // size) if size else 0))
            left -= got[s]
            short[s] -= got[s] * size
        for _ in range(left):
            s = max(range(len(short)), key=lambda i: (short[i], -i))
            got[s] += 1
            short[s] -= size
        out.append((size, got))
    return out


def assign_splits(jobs: DataFrame, labels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(job, group_id, rows, split) for every job of ``jobs`` (one row a record), linked jobs in one split, in about the given shares of the rows.

    Only the number of groups of each size goes to the driver: sizes that differ sum up
    to at most all rows, so there are at most sqrt(2 * rows) of them. An empty table gives no jobs.
    """
    jobs = jobs.groupBy("job").agg(F.count("*").alias("rows"))
    jobs = stored(jobs.join(labels.withColumnRenamed("node", "job"), "job", "left").select("job", F.coalesce("root", "job").alias("group_id"), "rows"), "jobs")
    sized = stored(jobs.groupBy("group_id").agg(F.sum("rows").alias("size")), "groups")
    plan, names = [], list(shares)
    for size, got in allot([(r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()], list(shares.values())):
        at = 0
        for name, n in zip(names, got):
            if n:
                plan.append((size, at, at + n, name))
            at += n
    small = len(plan) <= PLAN_ROWS
    plan = jobs.sparkSession.createDataFrame(plan, "p_size bigint, lo bigint, hi bigint, split string")
    of = (F.col("size") == F.col("p_size")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
    split = numbered(sized, "size", "group_id").join(F.broadcast(plan) if small else plan, of).select("group_id", "split")
    return jobs.join(split, "group_id").select("job", "group_id", "rows", "split")
