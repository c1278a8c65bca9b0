from pyspark.sql import functions as F

from runloom.functions import keys
from tests.conftest import T0, rows


def one(spark, value, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(f).collect()]


def test_job_number(spark):
    texts = ["12", " 12\t", "0012", "12.0", "12.", "12.5", "x12", "", None, "0", "123456789012345678901", "-3", "1e3"]
    assert one(spark, texts, "string", keys.job_number("x")) == [12, 12, 12, 12, 12, None, None, None, None, 0, None, None, None]


def test_reference(spark):
    full = "AB" * 20
    got = one(spark, [f" {full}\n", "", " \t", None, "HEAD"], "string", keys.reference("x"))
    assert got == [full.lower(), None, None, None, "head"]
    assert one(spark, [full.lower(), "0" * 40, "ab" * 19, "g" * 40], "string", keys.is_sha(F.col("x"))) == [True, False, False, False]
    assert one(spark, ["abcdef0", "abcdef", "a" * 39, "a" * 40, "abcdefg"], "string", keys.is_short_sha(F.col("x"))) == [True, False, True, False, False]


def test_usable(spark, make_runs):
    df = make_runs([
        {"timestamp": T0, "job_sequence": 1, "duration_ms": 0.0},
        {"timestamp": 1356998400, "job_sequence": 0, "duration_ms": -1.0},
        {"timestamp": T0 + 10**6, "job_sequence": 10**8, "duration_ms": float("nan")},
        {"timestamp": T0 + 10**6 + 1, "job_sequence": None, "duration_ms": float("inf")},
        {"timestamp": None, "job_sequence": 10**8 - 1, "duration_ms": 86_400_000.0},
    ])
    got = rows(df.select("id", keys.usable_timestamp().alias("t"), keys.usable_sequence().alias("s"), keys.usable_duration().alias("d")))
    assert got == [(1, T0, 1, 0.0), (2, None, None, None), (3, T0 + 10**6, None, None), (4, None, None, None), (5, None, 10**8 - 1, 86_400_000.0)]


def test_failed(spark):
    assert one(spark, ["FAIL", " error\t", "Pass", None, "failed"], "string", keys.failed("x")) == [True, True, False, False, False]


def test_epoch_does_not_depend_on_zone(spark, make_runs):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert make_runs([{}]).select(keys.epoch_s("loaded_at")).first()[0] == T0 + 10**6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
