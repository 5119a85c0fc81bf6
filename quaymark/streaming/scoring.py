"""Requests scored as a stream by a saved model, with two sinks: monitor records of valid requests, and the rejected ones.

Every micro-batch is written under its own id, monitor records first, then rejects, then its counts. A batch that is run
again after a failure overwrites what it left, and a batch counts as committed once its counts are there, so readers never
see half of one, and none twice.
"""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaymark.functions import payloads
from quaymark.operators import learning, preparation

# The fields of a monitor record in order, the feature set's version, and the decision threshold.
FIELDS = [
    "request_id", "timestamp", "decision", "probability", "latency_ms", "owasp_category", "atlas_tactic", "prompt_tokens", "completion_tokens", "model_version", "feature_version", "record_id",
]
FEATURE_VERSION = "v2025.08.10"
THRESHOLD = 0.03
REQUEST = "features array<double>, context struct<record_id: string, owasp_category: string, atlas_tactic: string>, received timestamp"
RECORD = "request_id string, timestamp string, decision int, probability double, latency_ms double, owasp_category string, atlas_tactic string, prompt_tokens double, completion_tokens double, model_version string, feature_version string, record_id string, line string, batch long"
REJECT = f"{REQUEST}, problem string, status int, batch long"
BATCH = "batch long, accepted long, rejected long, flagged long, ms double"


def utc_text(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(requests: DataFrame, model: PipelineModel, version: str, threshold: float = THRESHOLD) -> DataFrame:
    """The twelve fields of valid requests' monitor records, and their log line.

    requests: features, context, received. Without a context its categories read N/A and the record has no id; a null
    category of a context stays null. latency_ms is from ``received`` to scoring, null where that isn't known. Non-finite
    features count as 0.
    """
    columns = [payloads.finite(F.col("features")[i].cast("double")).alias(c) for i, c in enumerate(preparation.FEATURES)]
    scored = learning.probabilities(model, requests.select("context", "received", *columns))
    of = lambda f: F.when(F.col("context").isNull(), "N/A").otherwise(F.col(f"context.{f}"))
    now = F.current_timestamp()
    fields = {
        "request_id": F.replace(F.uuid(), F.lit("-"), F.lit("")), "timestamp": utc_text(now), "decision": (F.col("p") >= threshold).cast("int"), "probability": F.col("p"),
        "latency_ms": (F.unix_micros(now) - F.unix_micros("received")) / 1000.0, "owasp_category": of("owasp_category"), "atlas_tactic": of("atlas_tactic"), "prompt_tokens": F.col("prompt_tokens"),
        "completion_tokens": F.col("completion_tokens"), "model_version": F.lit(version), "feature_version": F.lit(FEATURE_VERSION), "record_id": F.col("context.record_id"),
    }
    found = scored.select(*[fields[k].alias(k) for k in FIELDS])
    return found.withColumn("line", F.concat(F.lit("MONITOR "), F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})))


class Sinks:
    """Writes micro-batches of requests (features, context, received) under a folder."""

    def __init__(self, home: str, model: PipelineModel, version: str, threshold: float = THRESHOLD):
        self.home, self.model, self.version, self.threshold = home, model, version, threshold

    def write(self, batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        checked = preparation.validated(batch).persist()  # both sinks read it; a lost executor reads it again
        try:
            self._put(records(checked.where("status = 200"), self.model, self.version, self.threshold), "monitor", number)
            self._put(checked.where("status <> 200").select("features", "context", "received", "problem", "status"), "rejected", number)
            # of what was written one column and the other's row counts are read; observed metrics would tie the session to
            # fitted models, which then can't be sent to tasks
            spark = batch.sparkSession
            good = spark.read.schema(RECORD).parquet(f"{self.home}/monitor/batch={number}").agg(F.count("*").alias("accepted"), F.count_if(F.col("decision") == 1).alias("flagged"))
            bad = spark.read.schema(REJECT).parquet(f"{self.home}/rejected/batch={number}").agg(F.count("*").alias("rejected"))
            counts = good.crossJoin(F.broadcast(bad)).select("accepted", "rejected", "flagged", F.lit((time.perf_counter() - began) * 1000).alias("ms"))  # one row each
            self._put(counts, "batches", number)
        finally:
            checked.unpersist()

    def _put(self, rows: DataFrame, sink: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.home}/{sink}/batch={number}")


def start(requests: DataFrame, sinks: Sinks) -> StreamingQuery:
    """Scores what is there of a stream of requests and goes on where an earlier run of the same folder ended."""
    return requests.writeStream.foreachBatch(sinks.write).option("checkpointLocation", f"{sinks.home}/state").trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def committed(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(monitor records, rejected requests, counts of batches) of the batches that are complete."""
    batches = _read(spark, f"{home}/batches", BATCH)
    done = F.broadcast(batches.select("batch"))  # a row a batch
    return (_read(spark, f"{home}/monitor", RECORD).join(done, "batch", "left_semi"), _read(spark, f"{home}/rejected", REJECT).join(done, "batch", "left_semi"), batches)
