"""Folders that driver and executors share, for what an operator writes before it goes on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where all executors run on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def place(spark: SparkSession, name: str) -> str:
    """A path in it that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table there: computed once, free of its lineage, whatever reads it. Options are those of the parquet writer."""
    path = place(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
