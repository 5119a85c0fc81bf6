"""Distinct counts from stored sketches: one sketch a key and column, united on read, so that a new day rereads no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of a sketch's registers: 16,384 keep the error near 0.8 %, at most 16 KB each.
LOG_K = 14


def store(rows: DataFrame, key: str, columns: list[str], home: str) -> None:
    """Writes the sketches of rows' keys under home, in place of those that the same keys had; other keys stay as they are."""
    made = rows.groupBy(key).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_K)).alias(c) for c in columns])
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(home)


def by_key(spark: SparkSession, home: str, key: str) -> DataFrame:
    """Each key's estimated distinct counts, named as the columns."""
    kept = spark.read.option("basePath", home).parquet(home)
    return kept.select(F.col(key).cast("string").alias(key), *[F.hll_sketch_estimate(c).alias(c) for c in kept.columns if c != key])


def overall(spark: SparkSession, home: str, where: str = "true") -> DataFrame:
    """Estimated distinct counts over all keys that meet a condition, in one row; no row of the data is read again."""
    kept = spark.read.option("basePath", home).parquet(home)
    kinds = dict(kept.dtypes)
    return kept.where(where).agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in kept.columns if kinds[c] == "binary"])
