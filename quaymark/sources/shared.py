"""Folders and tables that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder where the session keeps checkpoints; a local one only where it names none and is one machine."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="quaymark-")
    return f"{home}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that what follows doesn't depend on how it was made."""
    home = folder(df.sparkSession, "table")
    df.write.parquet(home)
    return df.sparkSession.read.schema(df.schema).parquet(home)
