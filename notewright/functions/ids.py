"""Identifiers r<row>_<number> of resources, and references Type/<id> to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"(?U)\Ar(\d+)_(\d+)\z"


def is_valid_id(x: Column) -> Column:
    return x.cast("string").rlike(_ID)


def parse_id(x: Column) -> Column:
    """struct(row, number) of a valid id, else null."""
    part = lambda i: F.regexp_extract(x, _ID, i).try_cast("bigint")
    return F.when(is_valid_id(x), F.struct(part(1).alias("row"), part(2).alias("number")))


def split_ref(x: Column) -> Column:
    """struct(type, id) of a reference: its first two parts, both null unless neither is empty."""
    parts = F.split(x, "/")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    good = (F.size(parts) >= 2) & (first != "") & (second != "")
    return F.struct(F.when(good, first).alias("type"), F.when(good, second).alias("id"))


def dense_renumber(numbers: Column) -> Column:
    """map<number, place among the distinct numbers, from 0>."""
    distinct = F.array_sort(F.array_distinct(numbers))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda _, i: i.cast("bigint")))


def remapped_id(x: Column, renumbered: Column) -> Column:
    """x with its leading number looked up in renumbered; other ids stay."""
    p = parse_id(x)
    return F.coalesce(F.concat(F.lit("r"), F.element_at(renumbered, p["row"]).cast("string"), F.lit("_"), p["number"].cast("string")), x)
