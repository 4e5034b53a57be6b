"""Gold annotations: flat tables and the fields there are. Input rows as schemas.GOLD_ENTITY."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import MISSING, strip
from notewright.schemas import DISCOVERY_IGNORED, GOLD_ENTRY_FIELDS, GOLD_FIELDS, GOLD_IGNORED


def _of_interest(cell: Column, field: str, ignored: Sequence[str]) -> Column:
    return (cell["field"] == field) & ~cell["tbl"].isin(*ignored)


def _is_value(cell: Column) -> Column:
    """Not null, and not a string that only says so."""
    says_missing = (cell["kind"] == "str") & F.lower(strip(cell["value"])).isin(*MISSING)
    return cell["value"].isNotNull() & ~says_missing


def flatten(entities: DataFrame, fields: Sequence[str] = GOLD_FIELDS, ignored: Sequence[str] = GOLD_IGNORED, separator: str = " | ") -> DataFrame:
    """One row for each entity: of each field the distinct values in order of appearance, joined.

    Values of different types are distinct (1 and "1"). Everything is an expression over the
    row's own cells, so order needs no shuffle; rows equal in all columns are then made one.
    """
    cells = F.flatten(F.coalesce("data", F.array().cast(entities.schema["data"].dataType)))

    def joined(field: str) -> Column:
        kept = F.filter("_cells", lambda c: _of_interest(c, field, ignored) & _is_value(c))
        distinct = F.array_distinct(F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["value"].alias("value"))))
        return F.when(F.size(distinct) > 0, F.array_join(F.transform(distinct, lambda c: c["value"]), separator)).alias(field)

    rows = entities.select("ROW_ID", "position", "entity_text", "entity_type", cells.alias("_cells"))
    return rows.select("ROW_ID", "position", "entity_text", "entity_type", *map(joined, fields)).dropDuplicates()


def flatten_entries(entities: DataFrame, fields: Sequence[str] = GOLD_ENTRY_FIELDS, ignored: Sequence[str] = GOLD_IGNORED) -> DataFrame:
    """One row for each data entry (one of nulls for an entity without any); of each field the entry's last value."""
    rows = entities.select(F.col("ROW_ID").alias("note_id"), "position", "entity_text", "entity_type", F.explode_outer("data").alias("_cells"))

    def last(field: str) -> Column:
        cell = F.try_element_at(F.filter("_cells", lambda c: _of_interest(c, field, ignored)), F.lit(-1))
        return F.when(_is_value(cell), cell["value"]).alias(field)

    return rows.select("note_id", "position", "entity_text", "entity_type", *map(last, fields)).dropDuplicates()


def discover(entities: DataFrame, ignored: Sequence[str] = DISCOVERY_IGNORED) -> DataFrame:
    """(tbl, field): the distinct tables and the fields each has; a table without fields has a null one."""
    cells = entities.select(F.explode(F.flatten("data")).alias("c")).select("c.tbl", "c.field").where(~F.col("tbl").isin(*ignored)).distinct()
    named = cells.groupBy("tbl").agg(F.array_sort(F.collect_set("field")).alias("fields"))  # a table's field names
    return named.select("tbl", F.explode_outer("fields").alias("field"))
