"""Forests and boosting by what they predict."""

import math
import random

import pytest
from pyspark.sql import functions as F

from herbarius.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    """A label that no plane fits: a step, a bump and a product."""
    r = random.Random(3)
    data = []
    for i in range(1500):
        a, b, c = r.uniform(-2, 2), r.uniform(-2, 2), r.random()
        data.append((i, a, b, c, 5.0 * (a > 0.5) + 4 * math.exp(-4 * b * b) + 2 * a * b + r.gauss(0, 0.1)))
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double").cache()


@pytest.mark.parametrize(("kind", "trees", "least"), [("forest", 30, 0.85), ("boosted", 30, 0.95)])
def test_trees_predict_rows_they_have_not_seen(rows, kind, trees, least):
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    r2 = lambda k: models.regression_metrics(models.trained(train, "y", ["a", "b", "c"], k, trees).transform(test), "y", "prediction").first().r2
    assert r2(kind) > least > 0.8 > r2("linear")


def test_rounds_are_as_many_as_asked():
    assert models.regressors("y")["boosted"].getMaxIter() == models.classifiers("y")["boosted"].getMaxIter() == 500
    assert models.regressors("y", trees=7)["forest"].getNumTrees() == 7


def test_more_rounds_fit_better(rows):
    error = [models.regression_metrics(models.trained(rows, "y", ["a", "b"], "boosted", n).transform(rows), "y", "prediction").first().mse for n in (2, 20)]
    assert error[1] < error[0] / 3


def test_trees_on_different_rows_are_those_on_all_rows(spark, tmp_path):
    rows = spark.range(6000).select((F.col("id") % 7).cast("double").alias("a"), (F.floor(F.col("id") / 7) % 5).cast("double").alias("b"), (F.rand(3) * 2).alias("noise"))
    rows = rows.withColumn("y", 3 * F.col("a") + F.when(F.col("b") > 2, 10.0).otherwise(0.0) + F.col("noise")).cache()
    gaps = F.when(F.rand(5) < 0.1, None).otherwise(F.col("a"))
    got = models.trained(rows.withColumn("a", gaps), "y", ["a", "b"], "boosted", trees=5)
    assert got.stages[-1].getOrDefault("weightCol") == "__weight"
    whole = models._pipeline(["a", "b"], models.regressors("y", trees=5)["boosted"]).fit(rows)
    mine = models.trained(rows, "y", ["a", "b"], "boosted", trees=5)
    predicted = lambda m: {(r.a, r.b): r.prediction for r in m.transform(rows.select("a", "b").distinct()).collect()}
    want = predicted(whole)
    assert all(abs(predicted(mine)[k] - v) < 1e-6 for k, v in want.items()) and len(want) == 35

    forest = models.trained(rows, "y", ["a", "b"], "forest", trees=12)
    forest.write().overwrite().save(str(tmp_path / "forest"))
    again = predicted(models.PipelineModel.load(str(tmp_path / "forest")))
    assert again == predicted(forest) and "__tree0" not in forest.transform(rows.limit(1)).columns
    plain = predicted(models._pipeline(["a", "b"], models.regressors("y", trees=12)["forest"]).fit(rows))
    assert all(abs(again[k] - v) < 2.0 for k, v in plain.items()) and [n for n, _, _ in models.importances(forest, ["a", "b"])] == ["a", "b"]
    assert len(forest.stages) == 15
    with pytest.raises(Exception, match="(?i)null"):
        models.trained(rows.withColumn("y", F.when(F.col("noise") > 0.01, F.col("y"))), "y", ["a", "b"], "boosted", trees=2)
