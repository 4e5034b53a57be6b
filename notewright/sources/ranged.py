"""Files that a task opens itself, to read parts of them: parquet footers, and nested documents member by member.

Spark lists the files and deals them out; a task opens its own through pyarrow, so these readers
need a store that pyarrow knows (local and mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from notewright.schemas import GOLD_ENTITY

#: Bytes of a document read at once, and rows a batch holds at most.
CHUNK_BYTES, BATCH_ROWS = 1 << 20, 2048


def opened(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


# --- footers -------------------------------------------------------------------------------------


def read_footer(file):
    """A parquet file's metadata; of an open file only the end is read."""
    import pyarrow.parquet as pq

    return pq.read_metadata(file)


def _per_file(files: DataFrame, inspect, schema: str) -> DataFrame:
    """The rows that inspect(path, metadata) gives for each file of `path`, one file open at a time."""

    names = T._parse_datatype_string(schema).names

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                store, place = opened(path)
                with store.open_input_file(place) as file:
                    rows += inspect(path, read_footer(file))
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(path): the parquet files at or below path; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")


def parquet_metadata(spark: SparkSession, path: str, shown: str | None = None, most: int = 300) -> DataFrame:
    """(file, has_metadata, keys, prefix): what the footers of parquet files say of their schema.

    prefix: the first bytes of the value of the key `shown`.
    """

    def inspect(file, metadata):
        found = metadata.schema.to_arrow_schema().metadata
        return [(file, found is not None, sorted(k.decode(errors="replace") for k in found or ()), (found or {}).get((shown or "").encode(), b"")[:most] or None)]

    return _per_file(parquet_files(spark, path), inspect, "file string, has_metadata boolean, keys array<string>, prefix binary")


def parquet_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, columns): names and Spark types of every file's columns, as its footer has them."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def inspect(file, metadata):
        schema = from_arrow_schema(metadata.schema.to_arrow_schema())
        return [(file, [{"name": f.name, "type": f.dataType.simpleString()} for f in schema])]

    return _per_file(parquet_files(spark, path), inspect, "file string, columns array<struct<name:string,type:string>>")


def drift(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, column, declared, found): declared columns that a file lacks (found is null) or has in another type."""
    declared = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(schema)}
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("declared")) for n, t in declared.items()]))
    each = parquet_columns(spark, path).select("file", F.map_from_entries("columns").alias("_have"), wanted.alias("w")).select("file", "w.*", F.try_element_at("_have", F.col("w.column")).alias("found"))
    return each.where(~F.col("declared").eqNullSafe(F.col("found")))


def declared_shards(spark: SparkSession, path: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """All parquet files at or below path in the declared columns and types, with `file_path`.

    A column that a file lacks has its default, or null; one of another type is cast, and null where
    that fails. Files of like columns are read together, each group in its own types.
    """
    fields, defaults = T._parse_datatype_string(schema).fields, defaults or {}
    names = [f.name for f in fields]
    own = F.filter("columns", lambda c: c["name"].isin(names))
    groups = parquet_columns(spark, path).groupBy(F.array_sort(own).alias("columns")).agg(F.collect_list("file").alias("files")).collect()  # names of files, as Spark's own listing holds
    found = None
    for g in groups:
        have = {c["name"]: c["type"] for c in g.columns}
        rows = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in have.items()) or "_none string").parquet(*g.files)
        column = lambda f, have=have: F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType)
        part = rows.select(*[column(f).alias(f.name) for f in fields], F.col("_metadata.file_path").alias("file_path"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], T.StructType([*fields, T.StructField("file_path", T.StringType())]))


# --- nested documents ----------------------------------------------------------------------------


_ENDS = tuple(",:}] \t\n\r")


def members(file, chunk: int = CHUNK_BYTES) -> Iterator[tuple[str, object]]:
    """(name, value) of the members of the JSON objects that follow each other in an open binary file.

    One member is held at a time, so the file may be of any size.
    """
    text = io.TextIOWrapper(io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file, encoding="utf-8", newline="")
    decoder, held, at, ended = json.JSONDecoder(), "", 0, False

    def more() -> None:
        nonlocal held, at, ended
        size = max(chunk, len(held) - at)  # as much again as is open, so that a long member is not scanned too often
        new = text.read(size)
        ended = not new
        held, at = held[at:] + new, 0

    def mark() -> str:
        """The next character that is no space; none at the end."""
        nonlocal at
        while True:
            while at < len(held) and held[at] in " \t\n\r":
                at += 1
            if at < len(held) or ended:
                return held[at : at + 1]
            more()

    def value():
        nonlocal at
        mark()
        while True:
            try:
                found, stop = decoder.raw_decode(held, at)
                if held[stop : stop + 1] in _ENDS if stop < len(held) else ended:  # a number may go on in what is not read yet
                    at = stop
                    return found
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    def expect(wanted: str) -> str:
        nonlocal at
        found = mark()
        if not found or found not in wanted:
            raise ValueError(f"expected one of {wanted!r}, found {found!r}")
        at += 1
        return found

    while mark():
        expect("{")
        if mark() == "}":
            expect("}")
            continue
        while True:
            name = value()
            expect(":")
            yield name, value()
            if expect(",}") == "}":
                break


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _GoldReader(DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, top = opened(self.folder)
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: -(x.size or 0)) if x.is_file and x.path.endswith((".json", ".txt", ".pkl")) and not x.base_name.startswith(("_", "."))]

    def read(self, partition: _File):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from notewright.sources.readers import PlainUnpickler, gold_rows

        schema = to_arrow_schema(self.schema)
        store = opened(self.folder)[0]
        with store.open_input_stream(partition.path) as file:
            documents = [PlainUnpickler(file).load()] if partition.path.endswith(".pkl") else ({name: value} for name, value in members(file))
            rows: list[dict] = []
            for document in documents:
                rows += gold_rows(document)
                while len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows[:BATCH_ROWS], schema)
                    rows = rows[BATCH_ROWS:]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class GoldFiles(DataSource):
    """Gold entities of the .json, .txt (JSON objects) and .pkl files below a folder: a partition a file, batches as it is read."""

    @classmethod
    def name(cls) -> str:
        return "gold_files"

    def schema(self) -> str:
        return GOLD_ENTITY

    def reader(self, schema) -> DataSourceReader:
        return _GoldReader(self.options["path"], schema)


def gold_files(spark: SparkSession, folder: str) -> DataFrame:
    """Gold entities (schemas.GOLD_ENTITY) of all nested files below folder; pickled code is never run."""
    spark.dataSource.register(GoldFiles)
    return spark.read.format("gold_files").load(folder)
