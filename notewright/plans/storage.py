"""Queries that write the given tables in each layout the library keeps, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import flatten
from notewright.plans import annotation, structured
from notewright.plans.tables import scratch, table
from notewright.sources import readers, sinks


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")


def csv_tree(spark, sf_dir):
    """Texts as CSV files in a folder for each language, read with the folder as category."""
    path = scratch(spark, "csv")
    _texts(spark, sf_dir).write.partitionBy("lang").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = readers.csv_tree(spark, path, "doc_id long, source string, text string")
    return found.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "category")


def training_files(spark, sf_dir):
    """Training pairs as JSON lines and back."""
    path = scratch(spark, "pairs")
    sinks.json_lines(_texts(spark, sf_dir).select(F.concat_ws(" ", "source", "lang").alias("input"), F.col("text").alias("output")), path)
    return readers.training_pairs(spark, path).select("input", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"))


def shard_folders(spark, sf_dir):
    """Results in a folder for each folder of the shards that they come from."""
    path, out = scratch(spark, "shards"), scratch(spark, "results")
    _texts(spark, sf_dir).drop("text").write.partitionBy("source").parquet(path)
    sinks.by_shard(readers.shards(spark, path, "doc_id long, lang string"), out)
    return spark.read.parquet(out).select("doc_id", "lang", F.col("shard_dir").cast("string").alias("shard_dir"))


def flat_tables(spark, sf_dir):
    """Codes and references as tables by note, read back: of each note how many, and the bucket it lies in."""
    path, notes = scratch(spark, "flat"), flatten.parsed(structured.notes(spark, sf_dir), "l_orderkey", "payload")
    sinks.flat_tables(flatten.codes(notes, "l_orderkey"), flatten.refs(notes, "l_orderkey"), path, "l_orderkey", 8)
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.countDistinct("bucket").alias(f"{name}_buckets"))
    return count("codes").join(count("refs"), "l_orderkey", "left").na.fill(0)


def tab_separated(spark, sf_dir):
    """A table read by its extension."""
    path = f"{scratch(spark, 'table')}.tsv"
    table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").write.csv(path, header=True, sep="\t")
    return readers.table(spark, path)


def exported_annotations(spark, sf_dir):
    """The flat export as CSV and back; what is empty there is missing."""
    path = scratch(spark, "export")
    sinks.annotation_export(annotation.annotation_export(spark, sf_dir), path)
    return spark.read.csv(path, header=True)


QUERIES = {f.__name__: f for f in (csv_tree, training_files, shard_folders, flat_tables, tab_separated, exported_annotations)}

ORACLES = {
    "csv_tree": "SELECT doc_id, source, sha256(text) AS text_sha256, 'lang=' || lang AS category FROM documents",
    "training_files": "SELECT source || ' ' || lang AS input, sha256(text) AS output_sha256 FROM documents",
    "shard_folders": "SELECT doc_id, lang, 'source=' || source AS shard_dir FROM documents",
    "flat_tables": "SELECT l_orderkey, count(*) AS n_codes, 1::BIGINT AS codes_buckets, count(*) - 1 AS n_refs, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END::BIGINT AS refs_buckets FROM lineitem GROUP BY l_orderkey",
    "tab_separated": "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_orderstatus FROM orders",
    "exported_annotations": f"SELECT note_id, row_key, field, correct, nullif(corrected_value, '') AS corrected_value, nullif(comment, '') AS comment FROM ({annotation.ORACLES['annotation_export']})",
}
