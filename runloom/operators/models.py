"""Learned orders of tests: boosted trees or a forest on the feature matrix, judged on later jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import evaluate


def train(rows: DataFrame, features: Sequence[str], label: str = "label", kind: str = "forest", trees: int = 20, depth: int = 5, seed: int = 42):
    """A fitted scorer. Failures are rare, so each class weighs the same in total; rows with a null feature count it as 0.

    Trees are grown over all rows by Spark: per level it aggregates binned statistics, never rows.
    """
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
    ready = filled(rows, features).withColumn("_label", F.col(label).cast("double")).withColumn("_weight", weight)
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(ready).select("_x", "_label", "_weight")
    common = {"featuresCol": "_x", "labelCol": "_label", "weightCol": "_weight", "maxDepth": depth, "seed": seed}
    model = RandomForestClassifier(numTrees=trees, **common) if kind == "forest" else GBTClassifier(maxIter=trees, **common)
    return model.fit(ready)


def filled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def scored(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``score``, the model's probability of a failure."""
    kept = rows.columns
    ready = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="_x").transform(rows.withColumns({f"_f{k}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for k, f in enumerate(features)}))
    out = PipelineModel([model]).transform(ready)
    return out.select(*kept, vector_to_array("probability")[1].alias("score"))


def held_out_apfd(train_rows: DataFrame, test_rows: DataFrame, features: Sequence[str], kind: str = "forest") -> DataFrame:
    """(repo, jobs, learned, random): the mean APFD of later jobs with a failure, in the model's order and in a random one."""
    model = train(train_rows, features, kind=kind)
    rows = scored(model, test_rows.withColumn("failed", F.col("label")), features)
    a = evaluate.apfd(evaluate.ranked(rows, F.desc("score"), F.col("test_id"))).where("faults > 0").select(*evaluate.JOB, F.col("apfd").alias("learned"))
    b = evaluate.apfd(evaluate.ranked(rows, *evaluate.random_order(42))).select(*evaluate.JOB, F.col("apfd").alias("random"))
    return a.join(b, list(evaluate.JOB)).groupBy("repo").agg(F.count("*").alias("jobs"), F.avg("learned").alias("learned"), F.avg("random").alias("random"))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by their share of the model's impurity gain, greatest first."""
    return sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
