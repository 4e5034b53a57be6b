"""Writers. One table a kind; nothing writes a file for each note."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import parent_name
from notewright.schemas import EXPORT
from notewright.sources.shared import place

BUCKETS = 64


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """(input, output) as JSON lines, other scripts unescaped, nulls written."""
    line_of(df).write.mode(mode).text(path)


def line_of(df: DataFrame) -> DataFrame:
    """(value): the JSON line of each training pair."""
    return df.select(F.to_json(F.struct("input", "output"), {"ignoreNullFields": "false"}).alias("value"))


def parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def flat_tables(codes: DataFrame, refs: DataFrame, path: str, key: str, buckets: int = BUCKETS, mode: str = "error") -> None:
    """codes and refs as two tables, in folders by a hash of the note: a note is found in one folder."""
    for name, df in (("codes", codes), ("refs", refs)):
        df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode(mode).partitionBy("bucket").parquet(f"{path}/{name}")


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """df as a catalogue table in the shared folder, in buckets by keys, a sorted file each.

    Written with one shuffle; tables of the same buckets are joined by these keys, and grouped by them,
    without another one, however often.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    ordered = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    ordered.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", place(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def keyed(df: DataFrame, path: str, key: str, files: int | None = None, mode: str = "error") -> None:
    """A table to look single keys up in: files by ranges of the key, sorted, with small row groups and pages and a bloom filter on it.

    A filter on the key skips files and row groups by their ranges or the bloom filter, and pages by the column index.
    """
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key).write.mode(mode)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(16 << 20), "parquet.page.row.count.limit": "1000"}
    writer.options(**options).parquet(path)


def report(df: DataFrame, path: str, mode: str = "error") -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)


def by_extension(df: DataFrame, path: str, mode: str = "error") -> None:
    """Training sequences as parquet, whatever extension is asked for; reading one back needs no other library."""
    df.write.mode(mode).parquet(path)


def append_annotations(entries: DataFrame, path: str) -> None:
    """Add to the log; nothing is rewritten, so two writers lose nothing."""
    entries.write.mode("append").parquet(path)


def annotation_export(export: DataFrame, path: str, mode: str = "error") -> None:
    """The flat export as CSV; raises ValueError if there is nothing to export."""
    if export.isEmpty():
        raise ValueError("no annotations yet")
    export.select(*EXPORT).write.mode(mode).csv(path, header=True)


def by_shard(df: DataFrame, path: str, file: str = "file_path", keep_folders: bool = True, mode: str = "error") -> None:
    """Results in a folder for each input folder, or all in one."""
    if keep_folders:
        df.withColumn("shard_dir", parent_name(F.col(file))).write.mode(mode).partitionBy("shard_dir").parquet(path)
    else:
        df.write.mode(mode).parquet(path)
