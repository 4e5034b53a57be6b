"""The same operators over files as they arrive, by Structured Streaming.

The operators take and give DataFrames, so a stream of shards goes through them unchanged; each
run takes what is new since the last and ends (availableNow), which is how a batch job resumes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import annotations


def shards(spark: SparkSession, folder: str, schema: str, names: str = "*.parquet", files_a_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files in folder whose name fits, with `file_path`."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", names)
    return reader.parquet(folder).select("*", F.col("_metadata.file_path").alias("file_path"))


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Append transform(stream) of all new files to the parquet table at out. Each file counts once."""
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_latest(log: DataFrame, out: str, checkpoint: str) -> None:
    """Fold a stream of annotation entries into tables of the latest of each row, one a batch.

    The state is one entry for each (note, row); out holds, for each batch, the rows it changed.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a batch that is run again replaces itself

    query = annotations.latest(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
