"""Streaming scoring that is stopped and started again."""

import json

import pytest
from pyspark.sql import functions as F

from quaymark.operators import learning, preparation
from quaymark.plans import serving
from quaymark.streaming import scoring


@pytest.fixture
def requests(spark, tmp_path):
    """Four files of requests, a batch each; of 40 requests a file every fifth is wrong."""
    rows = spark.range(160).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    features = F.when(F.col("id") % 5 == 0, F.array(F.lit(1.0))).otherwise(F.array_repeat(F.col("id") / 100, 15))
    made = rows.select(features.alias("features"), F.when(F.col("id") % 2 == 0, F.struct(F.col("id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("owasp_category"), F.lit("T").alias("atlas_tactic"))).alias("context"), F.col("ts").alias("received"), F.floor(F.col("id") / 40).alias("file"))
    for k in range(4):
        made.where(F.col("file") == k).drop("file").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(scoring.REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("sink", ["rejected", "batches"])
def test_restart_neither_doubles_nor_loses(spark, requests, tmp_path, sink):
    """The run dies after the first or the second write of its second batch; what comes after is as if it had not."""
    sinks = scoring.Sinks(f"{tmp_path}/out", learning.linear({"url_length": 1.0}, 0.0), "m")
    put, failed = sinks._put, []

    def fails(rows, name, number):
        if name == sink and number == 1 and not failed:
            failed.append(number)
            raise OSError("killed here")
        put(rows, name, number)

    sinks._put = fails
    with pytest.raises(Exception, match="killed here"):
        scoring.start(requests, sinks).awaitTermination()
    monitor, rejected, batches = scoring.committed(spark, sinks.home)
    assert failed and batches.count() == 1 and monitor.count() == 32 and rejected.count() == 8  # not the half batch
    scoring.start(requests, sinks).awaitTermination()
    monitor, rejected, batches = scoring.committed(spark, sinks.home)
    assert monitor.count() == 128 == monitor.select("request_id").distinct().count() and rejected.count() == 32 and batches.count() == 4
    ids = [r[0] for r in monitor.where("record_id is not null").select("record_id").collect()] + [r[0] for r in rejected.where("context is not null").select("context.record_id").collect()]
    assert sorted(map(int, ids)) == list(range(0, 160, 2))
    assert {r["problem"] for r in rejected.collect()} == {"length"} and batches.agg(F.sum("accepted")).first()[0] == 128
    scoring.start(requests, sinks).awaitTermination()  # nothing new
    assert scoring.committed(spark, sinks.home)[0].count() == 128


def test_record_has_its_twelve_fields(spark):
    one = spark.createDataFrame([([0.5] * 12 + [7.0, 8.0, float("nan")], None, None)], scoring.REQUEST)
    r = scoring.records(one, learning.linear({"latency_ms": 5.0, "url_length": 2.0}, -1.0), "v1").first()
    record = json.loads(r["line"].removeprefix("MONITOR "))
    assert list(record) == scoring.FIELDS == [c for c in r.asDict() if c != "line"] and len(record) == 12
    assert record["probability"] == 0.5 and record["decision"] == 1 and record["latency_ms"] is None and record["record_id"] is None
    assert (record["owasp_category"], record["prompt_tokens"], record["completion_tokens"], record["model_version"], record["feature_version"]) == ("N/A", 7.0, 8.0, "v1", "v2025.08.10")


def test_equal_requests_score_alike_and_no_batch_reads_empty(spark, tmp_path):
    twice = spark.createDataFrame([([1.0] * 15, None, None)] * 2, scoring.REQUEST)
    assert len({r["probability"] for r in scoring.records(twice, learning.linear({"num_dots": 0.3}, 0.1), "v").collect()}) == 1
    assert [x.count() for x in scoring.committed(spark, f"{tmp_path}/none")] == [0, 0, 0]
    assert len(preparation.FEATURES) == 15 and "stream_scoring" in serving.ORACLE
