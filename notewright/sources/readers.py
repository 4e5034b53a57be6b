"""Readers. Everything is read by Spark, so a path may be in any store that Spark knows."""

from __future__ import annotations

import io
import pickle

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import extension, parent_name, stem, strip
from notewright.schemas import ANNOTATION, GOLD_ENTITY


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def shards(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame | None:
    """All parquet files of a pattern, folders included, with `file_path`; None if there are none."""
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
    try:
        df = (reader.schema(schema) if schema else reader).parquet(pattern)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def csv_tree(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All CSV files below folder, with `category`: the name of each file's own folder.

    Quoted fields may hold line ends. All files must have the same header; union() joins others.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("enforceSchema", "false")
    df = (reader.schema(schema) if schema else reader).csv(folder, header=True, multiLine=True, quote='"', escape='"')
    return df.select("*", F.url_decode(parent_name(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("category"))


class PlainUnpickler(pickle.Unpickler):
    """Loads numbers, strings and containers of them; anything that names code is refused."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not plain data")


def _cell(table, field, value) -> dict:
    return {"tbl": str(table), "field": None if field is None else str(field), "kind": type(value).__name__, "value": None if value is None else str(value)}


def _entry_cells(entry: dict) -> list[dict]:
    cells = []
    for table, fields in entry.items():
        if isinstance(fields, dict):
            cells += [_cell(table, k, v) for k, v in fields.items()] or [_cell(table, None, None)]
    return cells


def gold_rows(document: dict) -> list[dict]:
    """Rows of schemas.GOLD_ENTITY from {row: [{entity text: its position, type and data}]}."""
    text = lambda x: None if x is None else str(x)
    rows = []
    for row_id, entities in document.items():
        for item in entities:
            if isinstance(item, dict) and len(item) == 1:
                ((entity, meta),) = item.items()
                data = [_entry_cells(e) for e in meta.get("data", [])]
                rows.append({"ROW_ID": str(row_id), "position": text(meta.get("position")), "entity_text": text(entity), "entity_type": text(meta.get("entity_type")), "data": data})
    return rows


def gold_pickles(spark: SparkSession, folder: str) -> DataFrame:
    """Gold entities of all pickles below folder; see gold_rows. Pickled code is never run."""

    def load(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([r for raw in batch["content"] for r in gold_rows(PlainUnpickler(io.BytesIO(raw)).load())], columns=["ROW_ID", "position", "entity_text", "entity_type", "data"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pkl").load(folder)
    return files.select("content").mapInPandas(load, GOLD_ENTITY)


def gold_json(spark: SparkSession, folder: str) -> DataFrame:
    """Gold entities of all JSON files below folder, in the shape of the pickles."""
    import json

    def load(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([r for raw in batch["value"] for r in gold_rows(json.loads(raw))], columns=["ROW_ID", "position", "entity_text", "entity_type", "data"])

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.mapInPandas(load, GOLD_ENTITY)


def training_pairs(spark: SparkSession, path: str, source: str = "input", target: str = "output") -> DataFrame:
    """(input, output) of a file of JSON lines."""
    return spark.read.schema(f"`{source}` string, `{target}` string").json(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet, comma or tab separated file, by its extension; raises ValueError for any other."""
    kind = path.lower().rpartition(".")[2]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, quote='"', escape='"')
    raise ValueError(f"unsupported file type: {path}")


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, stem, ext) of the files in folder; their contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("ext"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, note_text): the stripped texts that lie beside data files."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(stem(F.col("_metadata.file_path")).alias("stem"), strip(F.col("value")).alias("note_text"))


def with_note_text(df: DataFrame, texts: DataFrame, file: str) -> DataFrame:
    """df with the text beside its file, empty if there is none."""
    named = df.withColumn("stem", stem(F.col(file)))
    return named.join(texts, "stem", "left").drop("stem").withColumn("note_text", F.coalesce("note_text", F.lit("")))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(name, has_note): the data files in folder, by name."""
    files = _listing(spark, folder)
    notes = files.where("ext = '.txt'").select("stem", F.lit(True).alias("has_note"))
    data = files.where(F.col("ext").isin(".csv", ".tsv", ".parquet"))
    return data.join(notes, "stem", "left").select("name", F.coalesce("has_note", F.lit(False)).alias("has_note")).orderBy("name")


def annotation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A log (seq 0) of annotation documents <note>_annotations.json: a row of each annotated row.

    A document without a note id in its own notes is named by its file. A row whose annotation
    is no object has a null one.
    """
    files = spark.read.option("pathGlobFilter", "*_annotations.json").text(folder, wholetext=True)
    parsed = files.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"_annotations\.json\z", "").alias("file"), F.from_json("value", "map<string,string>").alias("doc"))
    meta = F.from_json(F.try_element_at("doc", F.lit("_meta")), "note_id string, last_updated string")
    named = parsed.select(F.coalesce(meta["note_id"], F.col("file")).alias("note_id"), meta["last_updated"].alias("updated_at"), F.explode("doc").alias("row_key", "_a")).where("row_key <> '_meta'")
    fields = F.transform_values(F.from_json("_a", "map<string,string>"), lambda _, v: F.when(v.startswith("{"), F.from_json(v, ANNOTATION)))
    return named.select("note_id", "row_key", fields.alias("annotation"), F.lit(0).cast("bigint").alias("seq"), "updated_at")


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    """Training sequences in their declared types."""
    from notewright.operators.tokens import typed

    return typed(spark.read.parquet(path))


def present(codes: DataFrame, key: str) -> DataFrame:
    """(key): notes that have a prediction."""
    return codes.select(key).distinct()
