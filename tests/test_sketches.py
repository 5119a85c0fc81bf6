"""Quantile and distinct-count sketches: their error, their size, and merging."""

import random

import pytest
from pyspark.sql import functions as F

from quaymark.streaming import jobs


def events(spark, n, expr="pmod(id * 7919, 1000003)"):
    return spark.range(n).selectExpr("timestamp_seconds(id % 300) AS ts", f"CAST({expr} AS DOUBLE) AS value")


@pytest.mark.parametrize("expr", ["pmod(id * 7919, 1000003)", "id", "-id", "pow(pmod(id * 31, 977), 3)"])
def test_rank_error_is_below_a_hundredth(spark, expr):
    shares = [0.01, 0.05, 0.5, 0.95, 0.99]
    df = events(spark, 200_000, expr)
    found = jobs.sketch_quantiles(jobs.sketched(df), shares).first()
    values = sorted(r[0] for r in df.select("value").collect())
    for q, x in zip(shares, found["quantiles"], strict=True):
        below, upto = sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)
        assert below - 0.01 <= q <= upto + 0.01, (q, x)


def test_state_stays_of_one_size(spark, tmp_path):
    """One window of 10^4 and of 10^6 values: the state store holds about as many bytes, an exact percentile's a hundred times as many."""
    def state(n, made):
        folder = f"{tmp_path}/{made.__name__}-{n}"
        events(spark, n).coalesce(1).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{folder}/in").withWatermark("ts", "1 minute")
        query = made(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.count()).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["memoryUsedBytes"]

    small, large = state(10_000, jobs.sketched), state(1_000_000, jobs.sketched)
    assert large < 1.5 * small and large < 100_000
    assert state(200_000, jobs.tumbling) > 10 * large  # a percentile keeps every distinct value


def test_merged_sketches_and_empty_windows(spark):
    rng = random.Random(4)
    rows = [(i % 7200, rng.gauss(0, 10) if i % 7200 < 6600 else None) for i in range(60_000)]
    df = spark.createDataFrame(rows, "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value")
    parts = jobs.sketched(df)
    whole = jobs.sketch_quantiles(jobs.merged(parts, F.date_trunc("hour", "start").alias("hour")), [0.5, 0.95]).orderBy("hour").collect()
    for k, r in enumerate(whole):
        values = sorted(v for s, v in rows if s // 3600 == k and v is not None)
        assert r["n"] == len(values) and all(abs(sum(v <= x for v in values) / len(values) - q) < 0.01 for q, x in zip((0.5, 0.95), r["quantiles"], strict=True))
    none = jobs.sketch_quantiles(parts.where("n = 0"), [0.5]).collect()
    assert none and all(r["quantiles"] is None for r in none) and jobs.sketched(df.limit(0)).count() == 0
