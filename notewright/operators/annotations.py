"""Human annotations as an append-only log, of which the latest entry of a row holds.

A log row (schemas.ANNOTATION_LOG) holds the whole annotation of one (note, row): a later entry
replaces an earlier one and fields are not merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import blank_missing
from notewright.schemas import EXPORT

META = "_meta"


def upsert(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with entries added. Raises ValueError if one has no row_key."""
    if not entries.where(F.col("row_key").isNull() | (F.col("row_key") == "")).isEmpty():
        raise ValueError("row_key required")
    return log.unionByName(entries.select(*log.columns))


def latest(log: DataFrame) -> DataFrame:
    """One row of each (note_id, row_key): that of the greatest seq. Works on a stream too."""
    return log.groupBy("note_id", "row_key").agg(F.max_by(F.struct("annotation", "seq", "updated_at"), "seq").alias("_l")).select("note_id", "row_key", "_l.*")


def export(current: DataFrame) -> DataFrame:
    """A row of each annotated field; what it lacks is empty."""
    rows = current.where(F.col("row_key") != META).select("note_id", "row_key", F.explode("annotation").alias("field", "_a")).where(F.col("_a").isNotNull())
    text = lambda c: F.coalesce(F.col(f"_a.{c}").cast("string"), F.lit("")).alias(c)
    return rows.select("note_id", "row_key", "field", text("correct"), text("corrected_value"), text("comment")).select(*EXPORT)


def progress(current: DataFrame) -> DataFrame:
    """Per note: annotated rows, and when the last of them was."""
    rows = current.where(F.col("row_key") != META)
    return rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("annotated_rows"), F.coalesce(F.max("updated_at"), F.lit("")).alias("last_updated"))


def stamped(entries: DataFrame) -> DataFrame:
    """entries with updated_at set to the present, in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return entries.withColumn("updated_at", now)


def documents(current: DataFrame) -> DataFrame:
    """(note_id, document): each note's annotations as one map of rows; a note's rows are what people have marked."""
    per_note = current.where(F.col("row_key") != META).groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("row_key", F.to_json("annotation").alias("annotation")))).alias("_r"), F.max("updated_at").alias("_at"))
    pair = lambda k, v: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(": "), v)
    rows = F.transform("_r", lambda r: pair(r["row_key"], r["annotation"]))
    meta = F.concat(F.lit(f'"{META}": '), F.to_json(F.struct("note_id", F.col("_at").alias("last_updated"))))
    return per_note.select("note_id", F.concat(F.lit("{"), F.array_join(F.concat(rows, F.array(meta)), ", "), F.lit("}")).alias("document"))


def display(df: DataFrame) -> DataFrame:
    """Every cell as text, missing ones empty."""
    return df.select(*[blank_missing(F.col(c)).alias(c) for c in df.columns])


def display_group(df: DataFrame, note_id: str, note_text: str) -> dict:
    """One note's table as an annotation page asks for it. Brings the note's rows to the driver."""
    rows = [r.asDict() for r in display(df).collect()]  # one note's table, for one reader
    return {"columns": df.columns, "note_ids": [note_id], "groups": {note_id: {"note_text": note_text, "rows": rows}}, "total_rows": len(rows)}
