"""Spark's rows against DuckDB's for the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings test_runs file_changes commits test_owners shared_test_owners raw_results".split()


def database(d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def differ(spark_df, con, sql):
    got = spark_df.collect()
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    a = sorted(tuple(shown(r[c]) for c in order) for r in got)
    b = sorted(tuple(shown(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    return [x for x in zip(a, b) if x[0] != x[1]][:5] or (len(a) != len(b) and (len(a), len(b)))
