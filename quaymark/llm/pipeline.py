"""From raw documents to packed sequences: each stage works on what the one before it kept, written as Parquet and read again.

A document stays if the quality classifier accepts it and no near copy of smaller doc_id stays; benchmark passages are cut
out of it, personal data gets surrogates, and what is left is tokenised and packed.

Defined results: null and empty texts go where the classifier rejects them, else one of them stays and packs as an end token;
long texts are taken whole; repeated rows leave one; an empty table gives no rows; other columns pass through all stages
but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, neardup, packing, pii, quality
from .common import shared_dir, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labelled ones, finds good."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return neardup.dedup(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return sized(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return sized(pii.replace(docs, pii.key(spark)).select(*[F.col(f"`{c}`") for c in docs.columns]))


def sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text now has."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences with their places."""
    return packing.pack(packing.tokenise(docs, packing.vocabulary))


STAGES = [("quality classifier", accept), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark_text), ("PII surrogates", surrogates), ("best-fit packing", packed)]

#: Digests, fingerprints and models aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def discard(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes once the next one has been written."""
    docs, home = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            discard(spark, f"{home}/{k - 1}")
    return docs
