"""Events with the attributes that were valid and already recorded at their time.

Versions are bitemporal: valid from ``valid_from``, recorded at ``known_at`` (null: when valid). What holds at time
t is the version with the greatest (valid_from, known_at, version_id) among those with both times <= t. As t grows
this is a step function that only changes when a version enters, at the later of its two times. Each attribute is
taken out of the versions before anything else and keeps its own change history, equal neighbours merged, so an
attribute that rarely changes has few changes however often the others do, and late records of one attribute never
touch the history of another.

All histories, one row per change of one attribute, and the events lie on one time axis per entity; each
attribute has its own last-known match there, and the matches of an event come back as its columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.commits import commit_times, known_commits
from runloom.functions.keys import epoch_s, reference, usable_timestamp
from runloom.operators.past import strictly_before

SHARED = "*"
ENTITY = ["scope", "test_id"]


def attribute_histories(versions: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(scope, test_id, attribute, at, value): from second ``at`` on, the attribute has this value; value is a struct of one field per
    attribute, of which only its own is set. Versions without valid_from never apply.

    A version becomes one row per attribute. Those of an attribute that enter in the same second are combined before the
    window, whose running maximum and comparison with the row before stream over the sorted rows of one test and attribute.
    """
    known = F.greatest(F.coalesce("known_at", "valid_from"), F.col("valid_from"))
    part = F.when(F.date_trunc("second", known) < known, 1).otherwise(0)  # the first whole second not before it
    rows = versions.where(F.col("valid_from").isNotNull() & F.col("test_id").isNotNull() & F.col("scope").isNotNull())
    order = [F.col("valid_from"), F.coalesce("known_at", "valid_from").alias("known_at"), F.col("version_id")]
    own = lambda a: F.struct(*[(F.col(b) if a == b else F.lit(None).cast(versions.schema[b].dataType)).alias(b) for b in attributes])
    long = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), own(a).alias("value")) for a in attributes])).alias("x")
    rows = rows.select(*ENTITY, (epoch_s(known) + part).alias("at"), F.struct(*order).alias("rank"), long)
    entered = rows.groupBy(*ENTITY, "x.attribute", "at").agg(F.max(F.struct("rank", "x.value")).alias("state"))
    by_time = Window.partitionBy(*ENTITY, "attribute").orderBy("at")
    holds = entered.withColumn("value", F.max("state").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))["value"])
    before = F.lag(F.struct("value")).over(by_time)
    changes = holds.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("value")))
    return changes.select(*ENTITY, "attribute", "at", "value")


def as_known_at(events: DataFrame, versions: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``events`` (scope, test_id, t and what else is to be carried) with each attribute as known at t, else null.

    Events and changes are range-partitioned by entity and time, so an entity with any share of the events, or any number of
    changes, lies in as many tasks as it needs; what was known before a task's part is one row per task and
    entity. Events meet no table in a join and are not multiplied. An attribute that is null in the version that applies
    is null in the result; events without scope or test_id have nulls; repeated events come out repeated.
    """
    carried = [c for c in events.columns if c not in ENTITY]
    changes = attribute_histories(versions, attributes).select(*ENTITY, (2 * F.col("at")).alias("_time"), "attribute", "value")
    both = events.withColumn("_time", 2 * F.col("t") + 1).withColumn("_event", F.lit(True)).unionByName(changes, allowMissingColumns=True)
    latest = {f"_last_{a}": F.when(F.col("attribute") == a, F.struct("_time", F.col(f"value.{a}").alias("v"))) for a in attributes}
    both = both.select(*ENTITY, *carried, "_time", "_event", *[c.alias(n) for n, c in latest.items()])
    found = strictly_before(both, ENTITY, "_time", maxima={f"_of_{a}": F.col(f"_last_{a}") for a in attributes}).where("_event")
    return found.select(*ENTITY, *carried, *[F.col(f"_of_{a}.v").alias(a) for a in attributes])


def event_times(test_runs: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, repo, test_id, t): t is the usable timestamp, else the committed_ts of the commit referred to.

    Only rows without a usable timestamp take part in the join with commits. Rows without either time are left out.
    """
    rows = test_runs.select("id", "repo", "test_id", usable_timestamp().alias("t"), reference().alias("ref"))
    timed = rows.where(F.col("t").isNotNull()).drop("ref")
    rest = rows.where(F.col("t").isNull() & F.col("ref").isNotNull()).drop("t")
    times = commit_times(rest, known_commits(commits)).withColumnRenamed("committed_ts", "t")
    return timed.unionByName(rest.join(times, ["repo", "ref"]).select("id", "repo", "test_id", "t").where(F.col("t").isNotNull()))


def run_attributes(test_runs: DataFrame, commits: DataFrame, owners: DataFrame, shared: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(id, test_id, t, attributes...) of each row with an event time. Tests in ``shared`` are looked up by test_id alone, all others
    by repo and test_id."""
    versions = owners.withColumnRenamed("repo", "scope").unionByName(shared.withColumn("scope", F.lit(SHARED)))
    of_all = shared.select(F.col("test_id").alias("s_test")).distinct()  # the engine broadcasts it by its size, which the table's definition fixes
    events = event_times(test_runs, commits).join(of_all, F.col("test_id") == F.col("s_test"), "left")
    events = events.select("id", F.when(F.col("s_test").isNotNull(), SHARED).otherwise(F.col("repo")).alias("scope"), "test_id", "t")
    return as_known_at(events, versions, attributes).drop("scope")
