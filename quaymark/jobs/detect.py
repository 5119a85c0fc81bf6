"""The batch jobs of detectors: train and save, score and monitor, evaluate and ablate, correlate, replay in waves.

    spark-submit -m quaymark.jobs.detect train     --splits data/processed/splits --model models --out reports/baseline
    spark-submit -m quaymark.jobs.detect score     --requests requests --model models/logistic_l1 --out scores --rejected rejected
    spark-submit -m quaymark.jobs.detect evaluate  --splits data/processed/splits --model models --out reports/eval
    spark-submit -m quaymark.jobs.detect ablate    --splits data/processed/splits --out reports/ablations
    spark-submit -m quaymark.jobs.detect correlate --splits data/processed/splits --out reports/correlation
    spark-submit -m quaymark.jobs.detect burst     --splits data/processed/splits --model models/logistic_l1 --total 1000 --concurrency 32 --out reports/burst
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import payloads
from quaymark.operators import learning, metrics, preparation, sampling
from quaymark.sources import feeds
from quaymark.streaming import jobs, scoring

FAMILIES = {
    "length": ["url_length", "domain_length", "path_length"], "punctuation": ["num_dots", "num_hyphens", "num_underscores", "num_slashes"],
    "protocol": ["has_ip", "is_https", "has_port"], "usage": ["num_params", "is_ai_endpoint"], "telemetry": ["prompt_tokens", "completion_tokens", "latency_ms"],
}
THRESHOLD = scoring.THRESHOLD
MODELS = ("logistic_l1", "random_forest")
#: Settings of training; a cap of None takes all rows.
TRAINING = {"use_smote": True, "logistic_penalty": "l1", "logistic_max_train_rows": None, "rf_max_train_rows": None, "rf_trees": 200, "rf_depth": 30}


def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of written splits as models read them, with their split."""
    return preparation.model_input(spark.read.parquet(path))


def fit(rows: DataFrame, path: str) -> PipelineModel:
    model = learning.logistic(preparation.FEATURES, l1=True).fit(learning.balanced(rows.where("split = 'train'")))
    model.write().overwrite().save(path)
    return model


def train(rows: DataFrame, path: str, version: str = "v1", settings: dict | None = None) -> DataFrame:
    """Fits both detectors on the train split, evened out by made rows and capped as the settings say, and saves them with a
    bundle document (version, columns, settings). Their metrics at 0.5: model, split and the rest, a row each.

    A cap takes rows by a hash of their values, so that it is repeatable; classes are weighed after it.
    """
    settings = TRAINING | (settings or {})
    if settings["logistic_penalty"] not in ("l1", "l2"):
        raise ValueError(f"unknown penalty {settings['logistic_penalty']}")
    columns, own = preparation.FEATURES, rows.where("split = 'train'")
    key = F.xxhash64(*columns)
    if settings["use_smote"]:
        own = sampling.oversample(own.withColumn("row", key), "y", "row", columns)
    own = own.select("y", *columns).persist()
    try:
        kinds = {
            "logistic_l1": (learning.logistic(columns, l1=settings["logistic_penalty"] == "l1"), settings["logistic_max_train_rows"]),
            "random_forest": (learning.forest(columns, settings["rf_trees"], settings["rf_depth"]), settings["rf_max_train_rows"]),
        }
        found, schema = [], None
        for name, (kind, cap) in kinds.items():
            few = sampling.capped(own, key, cap) if cap else own
            model = kind.fit(learning.balanced(few))
            model.write().overwrite().save(f"{path}/{name}")
            for split in ("validation", "test"):
                scores = learning.probabilities(model, rows.where(F.col("split") == split)).select("y", "p")
                one = learning.report(scores).select(F.lit(name).alias("model"), F.lit(split).alias("split"), F.lit(few.count()).alias("trained_on"), "*")
                found, schema = found + one.collect(), one.schema
    finally:
        own.unpersist()
    spark = rows.sparkSession
    lit = [F.lit(v).alias(k) for k, v in settings.items()]
    feeds.write_document(spark.range(1).select(F.lit(version).alias("model_version"), F.array(*map(F.lit, columns)).alias("feature_columns"), F.struct(*lit).alias("training")), f"{path}/bundle")
    return spark.createDataFrame(found, schema)


def load(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], str]:
    """Both trained detectors and their version."""
    return {m: PipelineModel.load(f"{path}/{m}") for m in MODELS}, spark.read.json(f"{path}/bundle").first()["model_version"]


def evaluated(rows: DataFrame, models: dict[str, PipelineModel]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, curves, agreement) of models at thresholds that are best on the validation split.

    metrics: model, split, threshold and the rates and areas there; curves: model and the ROC points of the test split;
    agreement: McNemar's test of the first two models on the test split, each at its threshold.
    """
    first, second = list(models)[:2]
    scores = rows.select("y", "split", *preparation.FEATURES)
    for m in models:
        scores = learning.probabilities(models[m], scores).withColumnRenamed("p", m).drop("confidence")
    scores = scores.select("y", "split", *models).persist()
    of = lambda m, split: scores.where(F.col("split") == split).select("y", F.col(m).alias("p"))
    table, curve, best = None, None, {}
    for m in models:
        best[m] = metrics.best_threshold(of(m, "validation")).first()["threshold"]  # one number
        for split in ("validation", "test"):
            row = learning.report(of(m, split), best[m]).select(F.lit(m).alias("model"), F.lit(split).alias("split"), F.lit(best[m]).alias("threshold"), "*")
            table = row if table is None else table.unionByName(row)
        points = metrics.roc_points(of(m, "test")).select(F.lit(m).alias("model"), "*")
        curve = points if curve is None else curve.unionByName(points)
    said = lambda m: (F.col(m) >= best[m]).cast("double")
    both = scores.where("split = 'test'").select("y", said(first).alias("p"), said(second).alias("q"))
    return table, curve, metrics.mcnemar_test(both)


def score(requests: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """Valid requests (record_id, features, context) with probability, decision and their monitor line. What isn't valid is
    given by ``preparation.accepted_rejected``; the job writes it out."""
    valid, _ = preparation.accepted_rejected(requests)
    columns = [payloads.finite(F.col("features")[i].cast("double")).alias(c) for i, c in enumerate(preparation.FEATURES)]
    scored = learning.probabilities(model, valid.select("record_id", "context", *columns)).select("record_id", "context", F.col("p").alias("probability"))
    line = jobs.monitor(scored, threshold)
    return line.withColumn("line", F.concat(F.lit("MONITOR "), F.to_json(F.struct(*line.columns))))


def burst(rows: DataFrame, model: PipelineModel, total: int | None, wave: int = 32) -> DataFrame:
    """Rows replayed up to total, with the wave that each belongs to and its probability."""
    ordered = rows.withColumn("row", F.monotonically_increasing_id())
    return learning.probabilities(model, sampling.replay(ordered, "row", total)).select("position", F.floor(F.col("position") / wave).alias("wave"), F.col("p").alias("probability"), "y")


def burst_latency(rows: DataFrame, model: PipelineModel, total: int | None, concurrency: int = 32, version: str = "v1") -> DataFrame:
    """mode, count, avg_ms, p50_ms, p95_ms, p99_ms, max_ms of rows replayed up to total, ``concurrency`` at a time.

    Each wave is a file and a micro-batch of the scoring stream; a request's latency is the time that its batch took, both
    sinks written.
    """
    spark, home = rows.sparkSession, jobs.shared(rows.sparkSession)
    ordered = sampling.replay(rows.withColumn("row", F.monotonically_increasing_id()), "row", total)
    made = ordered.select(F.array(*[F.col(c).cast("double") for c in preparation.FEATURES]).alias("features"), F.lit(None).cast("struct<record_id: string, owasp_category: string, atlas_tactic: string>").alias("context"), F.current_timestamp().alias("received"), F.floor(F.col("position") / concurrency).alias("wave"))
    made.repartition("wave").write.partitionBy("wave").parquet(f"{home}/in")
    stream = spark.readStream.schema(scoring.REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{home}/in")
    scoring.start(stream, scoring.Sinks(home, model, version)).awaitTermination()
    monitor, _, batches = scoring.committed(spark, home)
    each = monitor.select("batch").join(F.broadcast(batches.select("batch", "ms")), "batch")  # a row a wave
    p = metrics.percentiles(each, "ms")
    return p.select(F.lit("stream").alias("mode"), F.col("n").alias("count"), F.col("avg").alias("avg_ms"), *[F.col(c).alias(f"{c}_ms") for c in ("p50", "p95", "p99", "max")])


def correlations(rows: DataFrame) -> DataFrame:
    """f1, f2, corr of all features over all splits, both ways round."""
    half = metrics.pearson(rows, preparation.FEATURES)
    return half.unionByName(half.where("f1 <> f2").select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Train, score, evaluate, ablate, correlate or replay")
    parser.add_argument("command", choices=["fit", "train", "score", "evaluate", "ablate", "correlate", "burst"])
    for name in ("--splits", "--requests", "--model", "--out", "--rejected"):
        parser.add_argument(name)
    parser.add_argument("--total", type=int)
    parser.add_argument("--concurrency", type=int, default=32)
    parser.add_argument("--threshold", type=float, default=THRESHOLD)
    parser.add_argument("--version", default="v1")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "score":
        requests = spark.read.json(args.requests)
        score(requests, PipelineModel.load(args.model), args.threshold).write.mode("overwrite").json(args.out)
        preparation.accepted_rejected(requests)[1].write.mode("overwrite").json(args.rejected or f"{args.out}-rejected")
        return
    rows = split_rows(spark, args.splits)
    if args.command == "fit":
        fit(rows, args.model)
    elif args.command == "train":
        feeds.write_document(train(rows, args.model, args.version), args.out)
    elif args.command == "burst":
        feeds.write_document(burst_latency(rows.where("split = 'test'").drop("split"), PipelineModel.load(args.model), args.total, args.concurrency, args.version), args.out)
    elif args.command == "correlate":
        feeds.write_document(correlations(rows), args.out)
    elif args.command == "ablate":
        feeds.write_document(learning.ablations(rows, preparation.FEATURES, FAMILIES), args.out)
    else:
        table, curves, agreement = evaluated(rows, load(spark, args.model)[0])
        feeds.write_document(table, f"{args.out}/evaluation_summary")
        curves.write.mode("overwrite").partitionBy("model").option("header", True).csv(f"{args.out}/roc")
        feeds.write_document(agreement, f"{args.out}/mcnemar")


if __name__ == "__main__":
    main()
