"""Structured Streaming jobs over event files. Each runs what is there and leaves a table to read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.sources.shared import folder


def events(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """The events as a stream with a watermark; ts must be a timestamp to carry one."""
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(table.schema)
    alone = all(f.rpartition("/")[2] == name for f in table.inputFiles())  # the path is a file: streams read folders
    source = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return folder(spark, "stream")


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all available input into Parquet in the shared folder and reads that; its state lies there too.

    A result that is rewritten has a folder a batch, of which the last counts.
    """
    spark, home, batches = stream.sparkSession, shared(stream.sparkSession), []
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True)

    def rewritten(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/{batch}")
        batches.append(batch)

    if mode == "append":
        writer.format("parquet").start(f"{home}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{home}/rows")
    writer.foreachBatch(rewritten).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/{batches[-1]}") if batches else spark.createDataFrame([], stream.schema)


def tumbling(stream: DataFrame) -> DataFrame:
    g = stream.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))
    return g.select(F.col("w.start").alias("start"), "n", "p95")


def sliding(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct(stream: DataFrame) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def monitor(df: DataFrame, threshold: float = 0.03) -> DataFrame:
    """A monitor line per scored request: works on batches and streams alike. A missing context reads N/A; its nulls stay."""
    part = lambda f: F.when(F.col("context").isNull(), "N/A").otherwise(F.col(f"context.{f}"))
    return df.select("record_id", "probability", (F.col("probability") >= threshold).cast("int").alias("decision"), part("category").alias("category"), part("tactic").alias("tactic"))


def batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs the stream batch by batch: ``work`` turns a micro-batch into rows, which are appended to a table in the shared
    folder. A batch that is run again after a failure overwrites its own rows only."""
    spark, home = stream.sparkSession, shared(stream.sparkSession)
    schema = []

    def one(df: DataFrame, batch: int) -> None:
        out = work(df.withColumn("batch", F.lit(batch).cast("long")))
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{home}/rows/part={batch}")

    stream.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
    return spark.read.schema(schema[0]).parquet(f"{home}/rows") if schema else spark.createDataFrame([], stream.schema)


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Batches' partial sums put together."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*keys, "part", "batch")])


def day_counts(df: DataFrame) -> DataFrame:
    """A micro-batch's events and errors of each day."""
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


def rate_drift(days: DataFrame) -> DataFrame:
    """Each day's share of errors against the mean and three deviations of the seven days before. days: day, n, errors."""
    rate = days.select("day", (F.col("errors") / F.col("n")).alias("rate"))
    w = Window.orderBy("day").rowsBetween(-7, -1)  # a row a day
    m, s = F.avg("rate").over(w), F.stddev_samp("rate").over(w)
    return rate.select("day", F.round("rate", 6).alias("rate"), F.round(m, 6).alias("mean_7d"), F.coalesce((F.abs(F.col("rate") - m) > 3 * s).cast("int"), F.lit(0)).alias("alert"))


def median_drift(stream: DataFrame, least: float) -> DataFrame:
    """Hours whose median of value is under least."""
    g = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    return g.where(F.col("median") < least).select(F.col("w.start").alias("hour"), F.round("median", 6).alias("median"))


#: Of the quantile sketches; the rank error falls about as 1 / k, and a sketch holds about 3 k numbers whatever it has seen.
SKETCH_K = 512


def sketched(stream: DataFrame, width: str = "5 minutes", k: int = SKETCH_K) -> DataFrame:
    """Windows' quantile sketches of value: start, n, sketch. Streams and batches alike; null values count for nothing.

    Sketches are merged before the shuffle and in the state, which stays of one size however many values a window has.
    """
    g = stream.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    return g.select(F.col("w.start").alias("start"), "n", "sketch")


def merged(sketches: DataFrame, *by: Column, k: int = SKETCH_K) -> DataFrame:
    """Sketches of many windows as sketches of fewer: by, n, sketch. No value is read again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches with ``quantiles`` in place of the sketch: null where there was no value."""
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares)))
    return sketches.withColumn("quantiles", F.when(F.col("n") > 0, found)).drop("sketch")


def shadowed(live: DataFrame, shadow: DataFrame, apart: str = "5 minutes") -> DataFrame:
    """Live decisions joined with those of a shadow stream on the same request, at most so far apart in time.

    Both streams (event_id, ts, decision) carry watermarks, so state of either is dropped when it can't match any more.
    """
    a = live.select("event_id", F.col("ts").alias("live_ts"), F.col("decision").alias("live"))
    b = shadow.select(F.col("event_id").alias("shadow_id"), F.col("ts").alias("shadow_ts"), F.col("decision").alias("shadow"))
    near = F.expr(f"event_id = shadow_id AND shadow_ts BETWEEN live_ts - INTERVAL {apart} AND live_ts + INTERVAL {apart}")
    return a.join(b, near).select("event_id", "live", "shadow")
