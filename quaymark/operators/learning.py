"""Detectors on the lexical features: logistic regression and random forest, their metrics and feature-family ablations."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import metrics


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """df with a weight that makes the classes count alike."""
    n = df.groupBy(label).agg(F.count("*").alias("w_n"))
    t = n.agg(F.sum("w_n").alias("w_t"), F.count("*").alias("w_k"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(t)).withColumn("weight", F.col("w_t") / (F.col("w_k") * F.col("w_n"))).drop("w_n", "w_t", "w_k")


def logistic(columns: list[str], l1: bool = False, strength: float = 1e-4) -> Pipeline:
    lr = LogisticRegression(labelCol="y", weightCol="weight", featuresCol="scaled", elasticNetParam=float(l1), regParam=strength, standardization=False, maxIter=200)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr])


def forest(columns: list[str], trees: int = 50, depth: int = 10, seed: int = 42) -> Pipeline:
    rf = RandomForestClassifier(labelCol="y", weightCol="weight", featuresCol="raw", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), rf])


def legacy_forest(columns: list[str], seed: int = 42) -> Pipeline:
    """The older detector: 100 trees of depth 10 on unweighted rows, at least three rows a leaf for its least five a split."""
    rf = RandomForestClassifier(labelCol="y", featuresCol="raw", numTrees=100, maxDepth=10, minInstancesPerNode=3, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), rf])


def linear(weights: dict[str, float], intercept: float) -> PipelineModel:
    """A model of known coefficients, which can be saved and loaded like a fitted one; its output is p itself."""
    total = " + ".join(f"({w!r}D * `{c}`)" for c, w in weights.items())
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({intercept!r}D + {total}))) AS p FROM __THIS__")])


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p, the probability of class 1, and confidence."""
    scored = model.transform(df)
    if "p" in scored.columns:
        return scored.withColumn("confidence", F.greatest("p", 1 - F.col("p")))
    p = vector_to_array("probability")
    return scored.withColumn("p", p[1]).withColumn("confidence", F.array_max(p)).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rates at a threshold and areas of scores (y, p), in one row."""
    return metrics.rates(metrics.confusion(scores, threshold)).crossJoin(F.broadcast(metrics.areas(scores)))


def evaluate(pipeline: Pipeline, df: DataFrame, name: str) -> DataFrame:
    """Rates and areas on the rows whose split is test, of a model fitted on those whose split is train."""
    model = pipeline.fit(balanced(df.where("split = 'train'")))
    scores = probabilities(model, df.where("split = 'test'")).select("y", "p")
    return report(scores).select(F.lit(name).alias("experiment"), "*")


def ablations(df: DataFrame, columns: list[str], families: dict[str, list[str]], kinds: dict[str, Callable[[list[str]], Pipeline]] | None = None) -> DataFrame:
    """Each kind of model (the logistic one unless said) on all columns and without each family.

    The rows are read and weighed once and kept for all fits; what comes back is a row an experiment.
    """
    train, test = balanced(df.where("split = 'train'")).persist(), df.where("split = 'test'").persist()
    try:
        rows, schema = [], None
        for name, kind in (kinds or {"": logistic}).items():
            for k, v in {"baseline": [], **{f"minus_{k}": v for k, v in families.items()}}.items():
                scores = probabilities(kind([c for c in columns if c not in v]).fit(train), test).select("y", "p")
                found = report(scores).select(F.lit(f"{name}_{k}" if name else k).alias("experiment"), "*")
                rows, schema = rows + found.collect(), found.schema
        return df.sparkSession.createDataFrame(rows, schema)
    finally:
        train.unpersist()
        test.unpersist()


def cross_validated(df: DataFrame, pipeline: Pipeline, k: int = 5, fold: str = "fold", parallelism: int = 4) -> DataFrame:
    """fold (0 to k - 1) and its metrics, of models fitted on all other folds; rows have y and their fold's number.

    The weighed table is kept for all fits, which run side by side, each followed by its own metrics: a model a fold and no
    more. Features of a fold are scaled with what the others show.
    """
    rows = balanced(df).persist()

    def one(i: int) -> tuple[list, StructType]:
        model = pipeline.fit(rows.where(F.col(fold) != i))
        found = report(probabilities(model, rows.where(F.col(fold) == i)).select("y", "p")).select(F.lit(i).alias("fold"), "*")
        return found.collect(), found.schema

    try:
        rows.count()  # kept before the fits start, or each of them would make it
        with ThreadPool(min(k, parallelism)) as pool:
            done = pool.map(inheritable_thread_target(df.sparkSession)(one), range(k), chunksize=1)
        return df.sparkSession.createDataFrame([r for found, _ in done for r in found], done[0][1])
    finally:
        rows.unpersist()


def summary(folds: DataFrame, names: list[str]) -> DataFrame:
    """metric, n, mean, sem, low, high: each metric over the folds with its t-interval."""
    out = None
    for m in names:
        row = metrics.interval(folds, m).select(F.lit(m).alias("metric"), "*")
        out = row if out is None else out.unionByName(row)
    return out
