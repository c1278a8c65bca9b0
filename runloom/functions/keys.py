"""Normal forms of the dirty keys and values of the test tables, as column expressions.

All of them are null-safe, stay inside code generation and do not depend on the session's time zone for
columns without zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
NO_SHA = "0" * 40
FIRST_TIMESTAMP = 1356998400  # 2013-01-01 00:00:00 UTC
SEQUENCE_END = 100_000_000
LONGEST_MS = 86_400_000
DAY_S = 86400


def trimmed(c: str | Column) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def job_number(c: str = "job_id") -> Column:
    """job_id as a number; white space, leading zeros and a zero fraction do not matter. Null if it is no number."""
    t = trimmed(c)
    whole = F.when(t.rlike("^[0-9]{1,18}$"), t)
    return F.coalesce(whole.try_cast("bigint"), F.regexp_extract(t, r"^0*([0-9]{1,18})(?:\.0*)?$", 1).try_cast("bigint"))


def reference(c: str = "commit_sha") -> Column:
    """A commit reference in lower case without surrounding white space; null if there is none."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def is_sha(ref: Column) -> Column:
    """40 hex digits, not all zero. unhex gives null for text that is not hex, and is cheaper than a pattern."""
    return (F.length(ref) == 40) & F.unhex(ref).isNotNull() & (ref != NO_SHA)


def is_short_sha(ref: Column) -> Column:
    """7 to 39 hex digits."""
    return F.length(ref).between(7, 39) & F.unhex(ref).isNotNull()


def epoch_s(c: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    c = F.col(c) if isinstance(c, str) else c
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * DAY_S + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def usable_timestamp(ts: str = "timestamp", loaded: str = "loaded_at") -> Column:
    """The timestamp, or null where it stands for an absent one."""
    return usable_before(epoch_s(loaded), ts)


def usable_before(loaded_s: Column, ts: str = "timestamp") -> Column:
    """``usable_timestamp`` where the seconds of loading are at hand."""
    t = F.col(ts)
    return F.when((t > FIRST_TIMESTAMP) & (t <= loaded_s), t)


def usable_sequence(c: str = "job_sequence") -> Column:
    return F.when((F.col(c) >= 1) & (F.col(c) < SEQUENCE_END), F.col(c))


def usable_duration(c: str = "duration_ms") -> Column:
    """NaN is greater than every number in Spark, so the upper bound excludes it."""
    return F.when((F.col(c) >= 0) & (F.col(c) <= LONGEST_MS), F.col(c))


def failed(c: str = "outcome") -> Column:
    return F.coalesce(F.upper(trimmed(c)).isin("FAIL", "ERROR"), F.lit(False))


def run_key(job: str = "job_id", row: str = "id") -> Column:
    """The job number; a row whose job_id is no number is a run of its own, told by a negative key."""
    return F.coalesce(job_number(job), -F.col(row) - 1)
