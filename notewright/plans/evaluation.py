"""Queries over recall metrics: gold and predictions are made from lineitem, an order being a note."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import metrics
from notewright.plans.tables import table
from notewright.sources import sinks


def _sides(spark, sf_dir):
    """Gold mentions, predicted mentions, notes with a prediction.

    Predictions lack the lines of one discount and miss values of high tax; orders of the lowest
    priority have none at all.
    """
    lines = table(spark, sf_dir, "lineitem")
    quantity, number = F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string")
    name = F.concat("l_returnflag", "l_linestatus")
    gold = metrics.mentions(lines, "l_orderkey", F.concat(F.lit(" "), name, F.lit("\n")), F.when(F.col("l_discount") != 0, quantity), F.when(F.col("l_tax") != 0, number), ["l_partkey"])
    said = lines.where(F.col("l_discount") != 0.04)
    pred = metrics.mentions(said, "l_orderkey", F.lower(name), F.when(F.col("l_tax") <= 0.05, F.col("l_quantity").cast("int").cast("string")), F.concat(number, F.lit(".0")))
    present = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("ROW_ID"))
    return gold, pred, present


def recall_rows(spark, sf_dir):
    return metrics.row_metrics(*_sides(spark, sf_dir))


def recall_summary(spark, sf_dir):
    found = metrics.summary(metrics.row_metrics(*_sides(spark, sf_dir)))
    return found.select(*[F.round(c, 6).alias(c) if c.startswith(("micro", "macro")) else F.col(c) for c in found.columns])


def recall_merged(spark, sf_dir):
    return metrics.merged(*_sides(spark, sf_dir))


def recall_bucketed(spark, sf_dir):
    """recall_merged from tables kept in buckets by note and entity."""
    gold, pred, present = _sides(spark, sf_dir)
    key = ["ROW_ID", "entity"]
    kept = sinks.bucketed(metrics.with_prediction(gold, present), "gold_mentions", key), sinks.bucketed(pred, "pred_mentions", key)
    return metrics.matched(kept[0].hint("merge"), kept[1])


QUERIES = {f.__name__: f for f in (recall_rows, recall_summary, recall_merged, recall_bucketed)}

_MENTIONS = """l AS (SELECT *, lower(l_returnflag || l_linestatus) AS entity, l_quantity::INT::VARCHAR AS q, l_linenumber::VARCHAR AS n FROM lineitem),
gold AS (SELECT l_orderkey AS "ROW_ID", entity, CASE WHEN l_discount <> 0 THEN q WHEN l_tax <> 0 THEN n END AS value, l_partkey FROM l),
pred AS (SELECT l_orderkey AS "ROW_ID", entity, CASE WHEN l_tax <= 0.05 THEN q ELSE n END AS value FROM l WHERE l_discount <> 0.04),
present AS (SELECT DISTINCT o_orderkey AS "ROW_ID" FROM orders WHERE o_orderpriority <> '5-LOW')"""
_METRICS = f"""{_MENTIONS},
g AS (SELECT "ROW_ID", count(*) AS total_gold FROM gold GROUP BY 1), p AS (SELECT "ROW_ID", count(*) AS total_pred FROM pred GROUP BY 1),
e AS (SELECT "ROW_ID", count(*) AS n FROM (SELECT "ROW_ID", entity FROM gold INTERSECT ALL SELECT "ROW_ID", entity FROM pred) GROUP BY 1),
v AS (SELECT "ROW_ID", count(*) AS n FROM (SELECT "ROW_ID", entity, value FROM gold INTERSECT ALL SELECT "ROW_ID", entity, value FROM pred) GROUP BY 1),
c AS (SELECT "ROW_ID", total_gold, h."ROW_ID" IS NULL AS missing, CASE WHEN missing THEN 0 ELSE coalesce(total_pred, 0) END AS total_pred, CASE WHEN missing THEN 0 ELSE coalesce(e.n, 0) END AS em, CASE WHEN missing THEN 0 ELSE coalesce(v.n, 0) END AS vm
  FROM g LEFT JOIN p USING ("ROW_ID") LEFT JOIN e USING ("ROW_ID") LEFT JOIN v USING ("ROW_ID") LEFT JOIN present h USING ("ROW_ID")),
m AS (SELECT "ROW_ID", total_gold, total_pred, em AS entity_matched, vm AS value_matched, em / total_gold AS entity_recall, CASE WHEN missing THEN NULL WHEN em > 0 THEN vm / em ELSE 0 END AS value_accuracy_given_entity_match, vm / total_gold AS complete_fact_recall, missing AS missing_prediction_file FROM c)"""
_METRICS = _METRICS.replace('LEFT JOIN present h USING ("ROW_ID")', 'LEFT JOIN present h ON h."ROW_ID" = g."ROW_ID"').replace('c AS (SELECT "ROW_ID"', 'c AS (SELECT g."ROW_ID"')

ORACLES = {
    "recall_rows": f"WITH {_METRICS} SELECT * FROM m",
    "recall_summary": f"""WITH {_METRICS} SELECT count(*) AS n_rows, count_if(missing_prediction_file)::BIGINT AS n_rows_missing_prediction_file, sum(total_gold)::BIGINT AS global_total_gold, sum(entity_matched)::BIGINT AS global_entity_matched, sum(value_matched)::BIGINT AS global_value_matched,
  round(sum(entity_matched) / sum(total_gold), 6) AS micro_entity_recall, round(sum(value_matched) / sum(entity_matched), 6) AS micro_value_accuracy_given_entity_match, round(sum(value_matched) / sum(total_gold), 6) AS micro_complete_fact_recall,
  round(avg(entity_recall), 6) AS macro_entity_recall, round(avg(value_accuracy_given_entity_match), 6) AS macro_value_accuracy_given_entity_match, round(avg(complete_fact_recall), 6) AS macro_complete_fact_recall FROM m""",
    "recall_merged": f"""WITH {_MENTIONS} SELECT gold."ROW_ID" AS "ROW_ID", gold.entity AS entity_text, gold.value AS values_gold, l_partkey, pred.entity AS description, pred.value AS values_pred
FROM gold JOIN present USING ("ROW_ID") LEFT JOIN pred ON pred."ROW_ID" = gold."ROW_ID" AND pred.entity = gold.entity""",
}
ORACLES["recall_bucketed"] = ORACLES["recall_merged"]
