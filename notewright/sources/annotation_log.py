"""An annotation log on shared storage: small appended batches, folded into a base from time to time.

    <path>/batches/<name>   one append each
    <path>/bases/<name>     the latest entry of every row, of all batches folded so far

A folder counts once its writer has ended (_SUCCESS). The latest entry of a row wins, so an entry
that is read from a batch and from a base as well changes nothing: a reader takes all folders
that count, before, while and after a compaction, and a compaction that dies anywhere leaves the
same log. What a new base holds is removed only after it counts.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from notewright.operators.annotations import latest
from notewright.schemas import ANNOTATION_LOG


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of batches and bases that count."""
    jvm, found = spark._jvm, []
    for kind in ("batches", "bases"):
        top = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(top):
            for status in fs.listStatus(top):
                if fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found.append(status.getPath().toString())
    return found


def _new(path: str, kind: str) -> str:
    return f"{path}/{kind}/{time.time_ns():020d}-{uuid.uuid4().hex}"


def append(entries: DataFrame, path: str) -> None:
    """Add a batch; two writers at once lose nothing."""
    entries.write.parquet(_new(path, "batches"))


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(ANNOTATION_LOG).parquet(*folders) if folders else spark.createDataFrame([], ANNOTATION_LOG)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The entry that holds for each row."""
    return latest(_read(spark, _folders(spark, path)))


def compact(spark: SparkSession, path: str) -> None:
    """Fold all batches and bases there are into one new base."""
    folded = _folders(spark, path)
    latest(_read(spark, folded)).write.parquet(_new(path, "bases"))
    remove(spark, folded)


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
