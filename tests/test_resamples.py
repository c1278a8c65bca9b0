from runloom.operators import evaluate


def test_a_thousand_resamples_by_default(spark):
    values = spark.range(40).selectExpr("id k", "cast(id * id % 17 as double) v")
    default = evaluate.bootstrap_interval(values, "v", "k").first()
    assert default == evaluate.bootstrap_interval(values, "v", "k", resamples=1000).first()
    assert default != evaluate.bootstrap_interval(values, "v", "k", resamples=200).first()
