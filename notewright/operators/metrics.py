"""Recall of extracted concepts against gold annotations, per note and over all.

Mentions of both sides are tagged and added up together: by (note, entity, value), then by
(note, entity), then by note, each time reduced before the shuffle, so neither a hot note nor a
frequent entity gathers its mentions anywhere. Grouping takes null values as equal, which is what
the multiset intersection of values needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import normalize_text
from notewright.functions.values import normalize_value
from notewright.schemas import ROW_METRICS


def mentions(df: DataFrame, key: str, entity: Column, first: Column, second: Column, keep: list[str] | None = None) -> DataFrame:
    """(ROW_ID, entity, value, *keep): normal forms; the value is first, or else second. Without an entity a row goes."""
    found = df.select(F.col(key).alias("ROW_ID"), normalize_text(entity).alias("entity"), normalize_value(F.coalesce(first, second)).alias("value"), *(keep or []))
    return found.where(F.col("entity").isNotNull())


def row_metrics(gold: DataFrame, pred: DataFrame, present: DataFrame) -> DataFrame:
    """One row for each note of gold. gold, pred: mentions(); present: (ROW_ID) of notes with a prediction.

    A note without one has recalls of 0 and no value accuracy; with one but no match, all are 0.
    """
    present = present.select("ROW_ID").distinct()
    sides = gold.select("ROW_ID", "entity", "value", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select("ROW_ID", "entity", "value", F.lit(0).alias("g"), F.lit(1).alias("p")))
    by_value = sides.groupBy("ROW_ID", "entity", "value").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    by_entity = by_value.groupBy("ROW_ID", "entity").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.least("g", "p")).alias("v"))
    by_note = by_entity.groupBy("ROW_ID").agg(F.sum("g").alias("total_gold"), F.sum("p").alias("p"), F.sum(F.least("g", "p")).alias("e"), F.sum("v").alias("v")).where("total_gold > 0")
    joined = by_note.join(present.withColumn("_here", F.lit(True)), "ROW_ID", "left").withColumn("_here", F.coalesce("_here", F.lit(False)))
    here = lambda c: F.when(F.col("_here"), F.col(c)).otherwise(F.lit(0)).cast("bigint")
    counted = joined.select("ROW_ID", "total_gold", here("p").alias("total_pred"), here("e").alias("entity_matched"), here("v").alias("value_matched"), (~F.col("_here")).alias("missing_prediction_file"))
    found = counted.withColumns(
        {
            "entity_recall": F.col("entity_matched") / F.col("total_gold"),
            "value_accuracy_given_entity_match": F.when(F.col("missing_prediction_file"), F.lit(None).cast("double")).when(F.col("entity_matched") > 0, F.try_divide("value_matched", "entity_matched")).otherwise(0.0),
            "complete_fact_recall": F.col("value_matched") / F.col("total_gold"),
        }
    )
    return found.select(*ROW_METRICS)


def summary(rows: DataFrame) -> DataFrame:
    """One row: sums, micro metrics (over sums) and macro metrics (means over notes that have one)."""
    over = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("missing_prediction_file").alias("n_rows_missing_prediction_file"),
        F.coalesce(F.sum("total_gold"), F.lit(0)).alias("global_total_gold"),
        F.coalesce(F.sum("entity_matched"), F.lit(0)).alias("global_entity_matched"),
        F.coalesce(F.sum("value_matched"), F.lit(0)).alias("global_value_matched"),
        over("entity_matched", "total_gold").alias("micro_entity_recall"),
        over("value_matched", "entity_matched").alias("micro_value_accuracy_given_entity_match"),
        over("value_matched", "total_gold").alias("micro_complete_fact_recall"),
        F.avg("entity_recall").alias("macro_entity_recall"),
        F.avg("value_accuracy_given_entity_match").alias("macro_value_accuracy_given_entity_match"),
        F.avg("complete_fact_recall").alias("macro_complete_fact_recall"),
    )


def merged(gold: DataFrame, pred: DataFrame, present: DataFrame) -> DataFrame:
    """Gold mentions of notes with a prediction, each beside every predicted mention of the same entity.

    A mention that nothing matches stays, alone; repeated mentions multiply, which is the join's
    meaning, so its size follows the mentions of an entity within one note.
    """
    return matched(with_prediction(gold, present), pred)


def with_prediction(gold: DataFrame, present: DataFrame) -> DataFrame:
    """Gold mentions of notes that have a prediction."""
    return gold.join(present.select("ROW_ID").distinct(), "ROW_ID", "left_semi")


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The join of merged(); sides kept in buckets by (ROW_ID, entity) meet in it without a shuffle."""
    here = gold.withColumnsRenamed({"value": "values_gold", "entity": "entity_text"})
    other = pred.select("ROW_ID", F.col("entity").alias("entity_text"), F.col("entity").alias("description"), F.col("value").alias("values_pred"))
    return here.join(other, ["ROW_ID", "entity_text"], "left")
