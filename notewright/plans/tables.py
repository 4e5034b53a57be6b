"""Access to the test tables, and a shared folder for what queries write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewright.sources.shared import place


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return place(spark, name)
