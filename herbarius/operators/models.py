"""Regression and classification on scored tables with Spark ML."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.landed import stored_table
from .prep import stratified_split

#: Shares of the parts, and weights of the four qualities in the overall one (fixed values).
PARTS = {"train": 0.7, "validate": 0.15, "test": 0.15}
OVERALL = (0.4, 0.3, 0.2, 0.1)


def regressors(label: str, features: str = "features", trees: int = 500) -> dict:
    return {
        "linear": LinearRegression(labelCol=label, featuresCol=features),
        "forest": RandomForestRegressor(labelCol=label, featuresCol=features, numTrees=trees, maxDepth=12, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42),
        "boosted": GBTRegressor(labelCol=label, featuresCol=features, maxIter=trees, maxDepth=6, stepSize=0.1, seed=42),
    }


def classifiers(label: str, features: str = "features", weight: str = "__weight", trees: int = 500) -> dict:
    return {
        "logistic": LogisticRegression(labelCol=label, featuresCol=features, weightCol=weight),
        "forest": RandomForestClassifier(labelCol=label, featuresCol=features, weightCol=weight, numTrees=trees, maxDepth=10, seed=42),
        "boosted": GBTClassifier(labelCol=label, featuresCol=features, weightCol=weight, maxIter=trees, maxDepth=7, stepSize=0.1, seed=42),
    }


def _pipeline(columns: list[str], *last) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), *last])


#: Rows for each different row of features from which trees are fitted on the latter.
MANY = 8


def trained(train: DataFrame, label: str, columns: list[str], kind: str, trees: int = 500) -> PipelineModel:
    """A fitted pipeline: columns assembled and standardised, then the regressor.  Rows with a null are skipped.

    A tree sees of rows with equal features only how many there are and their mean label, so where rows are ``MANY``
    times the different ones, forests and boosting are fitted on these (:func:`_trained_on_cells`).
    """
    if kind != "linear":
        known = train.na.drop(subset=columns)
        rows, cells = known.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
        if 0 < cells * MANY <= rows:
            return _trained_on_cells(known, label, columns, kind, trees)
    return _pipeline(columns, regressors(label, trees=trees)[kind]).fit(train)


def _trained_on_cells(known: DataFrame, label: str, columns: list[str], kind: str, trees: int) -> PipelineModel:
    """Trees over different rows of features, weighed by their rows.

    A forest still draws its rows one by one: each row has a Poisson weight in each tree, as Spark's own bagging gives
    it, and only then are weights and labels summed.  What a tree drew twice or more are two instances, so
    that the least number of instances in a node means the same.  Each tree is a forest of one; the model's last stage is their mean.
    """
    ready = _pipeline(columns).fit(known)
    rows = known.select(*columns, F.col(label).cast("double").alias("__y"))
    # A missing label makes its cell's missing, which the regressor refuses.
    mean = lambda x: F.when(F.count("__y") == F.count("*"), x).alias(label)
    if kind != "forest":
        cells = stored_table(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("__weight"), mean(F.avg("__y"))), "cells")
        return PipelineModel([*ready.stages, regressors(label, trees=trees)[kind].setWeightCol("__weight").fit(ready.transform(cells))])

    forest = regressors(label, trees=1)["forest"]
    seed = forest.getSeed()
    each = rows.withColumn("__r", F.rand(seed)).withColumn("__tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = each.withColumn("__u", F.shiftrightunsigned(F.xxhash64("__r", "__tree"), 11) / F.lit(float(1 << 53)))
    times, chance, below = None, math.exp(-1), 0.0
    for k in range(18):
        below, chance = below + chance, chance / (k + 1)
        times = F.when(F.col("__u") < below, k) if times is None else times.when(F.col("__u") < below, k)
    times = times.otherwise(18)
    drawn = drawn.withColumn("__k", times).filter("__k > 0")
    cells = drawn.groupBy("__tree", *columns).agg(F.sum("__k").cast("double").alias("__w"), mean(F.sum(F.col("__k") * F.col("__y")) / F.sum("__k")))
    halves = F.explode(F.array_repeat(F.col("__w") / F.least("__w", F.lit(2.0)), F.least("__w", F.lit(2.0)).cast("int")))
    cells = stored_table(cells.select("__tree", *columns, label, halves.alias("__weight")).sortWithinPartitions("__tree"), "cells")

    def one(i: int):
        tree = regressors(label, trees=1)["forest"].setBootstrap(False).setWeightCol("__weight").setPredictionCol(f"__tree{i}").setSeed(seed + i)
        return tree.fit(ready.transform(cells.filter(F.col("__tree") == i)))

    with ThreadPool(min(trees, 8)) as pool:
        grown = pool.map(inheritable_thread_target(known.sparkSession)(one), range(trees))
    names = [f"__tree{i}" for i in range(trees)]
    average = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}), ({' + '.join(names)}) / {trees} AS prediction FROM __THIS__")
    return PipelineModel([*ready.stages, *grown, average])


def evaluated(df: DataFrame, record: str, stratum: str, label: str, columns: list[str], kind: str, trees: int = 500, parts: dict[str, float] = PARTS) -> tuple[PipelineModel, DataFrame]:
    """(the model fitted on the first part of a stratified split, its metrics on each other part)."""
    split = stratified_split(df, record, stratum, parts, name="__part")
    first, *others = parts
    model = trained(split.filter(F.col("__part") == first), label, columns, kind, trees)
    return model, regression_metrics(model.transform(split.filter(F.col("__part").isin(others))), label, "prediction", "__part").withColumnRenamed("__part", "part")


def regression_metrics(df: DataFrame, label: str, prediction: str, by: str | None = None) -> DataFrame:
    """mae, mse, rmse, r2: one row, or one for each value of ``by``."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*([by] if by else [])).agg(F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("v"))
    return sums.select(*([by] if by else []), "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - ratio("mse", "v")).alias("r2"))


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float, float]]:
    """(column, importance, its deviation over the trees), largest first, of a fitted tree pipeline."""
    forests = [s for s in model.stages if hasattr(s, "featureImportances")]
    each = [t.featureImportances.toArray().tolist() for f in forests for t in f.trees]
    whole = np.sum([f.featureImportances.toArray() for f in forests], axis=0)
    whole = (whole / (whole.sum() or 1.0)).tolist()
    mean = [sum(x) / len(each) for x in zip(*each, strict=True)]
    deviation = [(sum((v - m) ** 2 for v in x) / len(each)) ** 0.5 for x, m in zip(zip(*each, strict=True), mean, strict=True)]
    return sorted(zip(columns, whole, deviation, strict=True), key=lambda x: (-x[1], x[0]))


def overall_quality(df: DataFrame, train: DataFrame, labels: list[str], columns: list[str], kind: str = "forest", trees: int = 10, weights: tuple[float, ...] = OVERALL) -> DataFrame:
    """``df`` with a prediction for each label, from a model of its own, and their weighted sum ``overall``."""
    for label in labels:
        fitted = trained(train, label, columns, kind, trees)
        df = fitted.transform(df).withColumnRenamed("prediction", f"{label}_predicted").drop("raw", "features")
    return df.withColumn("overall", sum(F.lit(w) * F.col(f"{n}_predicted") for w, n in zip(weights, labels, strict=True)))


def trained_classifier(train: DataFrame, label: str, columns: list[str], kind: str = "logistic", trees: int = 500) -> PipelineModel:
    """A fitted pipeline whose rows weigh n / (2 n of their class), so that classes balance."""
    counts = train.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("__k")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    weighted = train.join(F.broadcast(counts.join(F.broadcast(total))), F.col(label) == F.col("__k")).withColumn("__weight", F.col("__all") / (2 * F.col("__n")))
    return _pipeline(columns, classifiers(label, trees=trees)[kind]).fit(weighted)


def classification_metrics(df: DataFrame, label: str, prediction: str = "prediction", raw: str = "rawPrediction") -> dict[str, float]:
    """Counts of the confusion matrix, accuracy, precision, recall, and areas under both curves."""
    cell = lambda a, b: F.count_if((F.col(label) == a) & (F.col(prediction) == b))
    r = df.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")).first().asDict()
    out = r | {"accuracy": (r["tp"] + r["tn"]) / max(1, sum(r.values())), "precision": r["tp"] / max(1, r["tp"] + r["fp"]), "recall": r["tp"] / max(1, r["tp"] + r["fn"])}
    for name, metric in (("roc", "areaUnderROC"), ("pr", "areaUnderPR")):
        out[name] = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName=metric).evaluate(df)
    return out


def logistic_curve(df: DataFrame, x: str, label: str, points: int = 200) -> DataFrame:
    """``x, probability`` at even steps between the least and greatest x, of a logistic fit without penalty."""
    model = Pipeline(stages=[VectorAssembler(inputCols=[x], outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol=label)]).fit(df)
    ends = df.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"))
    steps = df.sparkSession.range(points).join(F.broadcast(ends)).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("id") / max(1, points - 1)).alias(x))
    return model.transform(steps).select(x, vector_to_array("probability")[1].alias("probability"))
