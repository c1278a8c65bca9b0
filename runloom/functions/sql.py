"""The normal forms of ``keys`` and ``runs`` in DuckDB's SQL, for the queries' oracles."""

from __future__ import annotations

BLANK = r"E' \t\n\r\x0b\x0c'"
JOB = rf"try_cast(nullif(regexp_extract(trim(job_id, {BLANK}), '^0*([0-9]{{1,18}})(\.0*)?$', 1), '') as bigint)"
REF = rf"nullif(lower(trim(commit_sha, {BLANK})), '')"
USABLE_TS = "case when timestamp > 1356998400 and timestamp <= floor(epoch(loaded_at)) then timestamp end"
USABLE_MS = "case when not isnan(duration_ms) and duration_ms between 0 and 86400000 then duration_ms end"
FAILED = rf"coalesce(upper(trim(outcome, {BLANK})) in ('FAIL', 'ERROR'), false)"
RUNS = f"""runs as (
  select test_id, arg_min(ts, id) ts, arg_min(f, id) failed, arg_min(ms, id) ms, min(id) id from (
    select id, test_id, coalesce({JOB}, -id - 1) as job, struct_pack(v := {USABLE_TS}) as ts, {FAILED} as f, struct_pack(v := {USABLE_MS}) as ms
    from test_runs where test_id is not null) group by job, test_id)"""
