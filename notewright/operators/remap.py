"""Resource ids: check, renumber from zero, and put aside rows that can't be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.jsontext import remap_by_python, renumbered
from notewright.sources.shared import written


def classified(df: DataFrame, payload: str) -> DataFrame:
    """df with payload renumbered and `invalid_reason`, null where it could be; written once, as both kinds are read from it.

    Python sees only texts with escapes in ids and those a strict reader refuses.
    """
    shown = lambda done: [F.col(f"{done}.text").alias(c) if c == payload else F.col(c) for c in df.columns] + [F.col(f"{done}.reason").alias("invalid_reason")]
    rows = written(df.withColumn("_native", renumbered(F.col(payload))), "renumbered")
    left = rows.where("_native IS NULL")
    told = rows.where("_native IS NOT NULL").select(*shown("_native"))
    if left.isEmpty():
        return told
    return told.unionByName(written(left.withColumn("_done", remap_by_python(F.col(payload))).select(*shown("_done")), "renumbered"))


def remap_ids(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(clean, invalid): rows with good ids, renumbered; and the others, invalid_reason first."""
    rows = classified(df, payload)
    good = F.col("invalid_reason").isNull()
    return rows.where(good).drop("invalid_reason"), rows.where(~good).select("invalid_reason", *df.columns)
