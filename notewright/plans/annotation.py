"""Queries over the annotation log: labels are annotations, a source is a note, a document a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import annotations
from notewright.plans.tables import scratch, table
from notewright.sources import annotation_log
from notewright.streaming import shards


def log(spark, sf_dir):
    """A first annotation of every labelled document and a second one of every toxic one."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    mark = lambda right, said: f"named_struct('correct', {right}, 'corrected_value', {said}, 'comment', cast(null as string))"
    one = F.expr(f"map('quality', {mark('quality = 1', 'cast(quality as string)')}, 'toxic', {mark('toxic = 0', 'cast(null as string)')})")
    two = F.expr(f"map('toxic', {mark('true', chr(39) + 'checked' + chr(39))})")
    entry = lambda annotation, seq, df: df.select(F.col("source").alias("note_id"), F.concat(F.lit("row_"), "doc_id").alias("row_key"), annotation.alias("annotation"), F.lit(seq).cast("bigint").alias("seq"), F.concat(F.lit("2024-01-0"), F.lit(seq + 1), F.lit("T00:00:00Z")).alias("updated_at"))
    return entry(one, 0, rows), entry(two, 1, rows.where("toxic = 1"))


def _current(spark, sf_dir):
    first, second = log(spark, sf_dir)
    return annotations.latest(annotations.upsert(first, second))


def annotation_upsert(spark, sf_dir):
    """The entry that holds for each row."""
    return _current(spark, sf_dir).select("note_id", "row_key", "seq", F.array_join(F.array_sort(F.map_keys("annotation")), ",").alias("fields"))


def annotation_export(spark, sf_dir):
    return annotations.export(_current(spark, sf_dir))


def annotation_progress(spark, sf_dir):
    return annotations.progress(_current(spark, sf_dir))


def display_table(spark, sf_dir):
    """A table as a page shows it: text in every cell, none for what is missing."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), F.when(F.col("event_type") == "purchase", F.lit(float("nan"))).otherwise(F.col("user_id").cast("double")).alias("score"), "props")
    return annotations.display(events.withColumn("score", F.when(F.isnan("score"), F.lit("nan")).otherwise(F.col("score").cast("bigint").cast("string"))))


def stream_events(spark, sf_dir):
    """Events taken as a stream of files, twice; the second run finds nothing new."""
    path = scratch(spark, "stream")
    schema = table(spark, sf_dir, "events", "event_id", "event_type", "value").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    for _ in range(2):
        stream = shards.shards(spark, sf_dir, schema, "events.parquet")
        shards.run_available(stream, lambda df: df.where("event_type <> 'error'").drop("file_path"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


def annotation_compacted(spark, sf_dir):
    """What holds after three batches of entries, folded after the second and again at the end; events are the entries."""
    path, events = scratch(spark, "annotations"), table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    mark = F.struct((F.col("value") > 50).alias("correct"), F.col("value").cast("string").alias("corrected_value"), F.lit(None).cast("string").alias("comment"))
    entries = events.select(F.concat(F.lit("user_"), "user_id").alias("note_id"), F.col("event_type").alias("row_key"), F.create_map(F.lit("value"), mark).alias("annotation"), F.col("event_id").alias("seq"), F.lit("2024-01-01T00:00:00Z").alias("updated_at"))
    third = (events.agg(F.max("event_id")).first()[0] or 0) // 3
    batches = entries.where(F.col("seq") > 2 * third), entries.where(F.col("seq") <= third), entries.where((F.col("seq") > third) & (F.col("seq") <= 2 * third))
    for batch, fold in zip(batches, (False, True, True), strict=True):  # the newest entries come first: order of arrival decides nothing
        annotation_log.append(batch, path)
        if fold:
            annotation_log.compact(spark, path)
    return annotation_log.current(spark, path).select("note_id", "row_key", "seq", F.col("annotation.value.correct").alias("correct"))


QUERIES = {f.__name__: f for f in (annotation_upsert, annotation_export, annotation_progress, display_table, stream_events, annotation_compacted)}

_LOG = "r AS (SELECT source AS note_id, 'row_' || doc_id AS row_key, quality, toxic FROM labels JOIN documents USING (doc_id)), c AS (SELECT note_id, row_key, max(toxic) AS toxic, max(quality) AS quality FROM r GROUP BY ALL)"

ORACLES = {
    "annotation_upsert": f"WITH {_LOG} SELECT note_id, row_key, toxic::BIGINT AS seq, CASE toxic WHEN 1 THEN 'toxic' ELSE 'quality,toxic' END AS fields FROM c",
    "annotation_export": f"""WITH {_LOG} SELECT note_id, row_key, 'quality' AS field, (quality = 1)::VARCHAR AS correct, quality::VARCHAR AS corrected_value, '' AS comment FROM c WHERE toxic = 0
UNION ALL SELECT note_id, row_key, 'toxic', 'true', CASE toxic WHEN 1 THEN 'checked' ELSE '' END, '' FROM c""",
    "annotation_progress": f"WITH {_LOG} SELECT note_id, count(*) AS annotated_rows, CASE max(toxic) WHEN 1 THEN '2024-01-02T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS last_updated FROM c GROUP BY note_id",
    "display_table": "SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS event_type, CASE WHEN event_type = 'purchase' THEN '' ELSE user_id::VARCHAR END AS score, props FROM events",
    "annotation_compacted": "SELECT 'user_' || user_id AS note_id, event_type AS row_key, max(event_id) AS seq, arg_max(value > 50, event_id) AS correct FROM events GROUP BY ALL",
    "stream_events": "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'",
}
