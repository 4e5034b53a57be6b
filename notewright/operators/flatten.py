"""Flat tables from JSON arrays of resources: codes, references, and a manifest of notes.

codes() and the reference walk read texts straight to what they write once; parsed() writes one
variant an element, for status and for several readers. The strict native reader takes almost every text; those that it
refuses are told apart by jsontext.json_kind, which alone runs in Python and only on them. Values
keep the form they have in the text; objects and lists become JSON text. Notes whose array is
empty or whose values have mixed types stay.

Each of codes(), refs() and manifest() takes (df, key, payload), or what parsed() gave and no payload.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.ids import split_ref
from notewright.functions.jsontext import json_kind, strict_items
from notewright.functions.values import is_normal, normalize_value
from notewright.schemas import CODE_PATHS, CODES
from notewright.sources.shared import written

#: Levels that a walk takes in its first pass over resources; each further pass takes twice as many, up to the second.
FIRST_LEVELS, MOST_LEVELS = 6, 48

#: Values that mostly differ are written as they are: looking them up in dictionaries costs more than the bytes do.
PLAIN = {"parquet.enable.dictionary": "false"}

#: Columns of a resource that a reference to it is resolved by.
NAMED = ("resource_index", "id", "description")


def parsed(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, note_status, items), written once: ok, ok_empty, skipped (no payload) or error (not an array); items are the elements of an ok one."""
    text = F.col(payload)
    some = text.isNotNull() & (text != "")
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    first = df.select(F.col(key), some.alias("_some"), F.when(some, strict_items(text)).alias("_doc"), text.alias("_text"))
    first = first.select(key, "_some", F.col("_doc.items").alias("_items"), F.when(F.col("_some") & F.col("_doc").isNull(), F.col("_text")).alias("_refused"))
    notes = written(first, "parsed")
    refused = F.col("_refused").isNotNull()
    status = F.when(~F.coalesce("_some", F.lit(False)), "skipped").when(F.col("_items").isNull() & ~F.col("_array"), "error").when(F.size("_items") == 0, "ok_empty").otherwise("ok")
    told = lambda rows: rows.select(key, status.alias("note_status"), "_items").select(key, "note_status", F.when(F.col("note_status") == "ok", F.col("_items")).alias("items"))
    plain = told(notes.where(~refused).withColumn("_array", F.lit(False)))
    if notes.where(refused).isEmpty():
        return plain
    kinds = notes.where(refused).withColumn("_kind", json_kind("_refused")).withColumn("_array", F.col("_kind.kind") == "array")
    read = items(F.try_parse_json(F.coalesce("_kind.rewritten", F.when(F.col("_array"), F.col("_refused")))))
    return plain.unionByName(told(written(kinds.select(key, "_some", read.alias("_items"), "_array"), "refused")))


def _notes(df: DataFrame, key: str, payload: str | None) -> DataFrame:
    return df if payload is None else parsed(df, key, payload)


def manifest(df: DataFrame, key: str, payload: str | None = None) -> DataFrame:
    """(key, note_status): what became of each note."""
    return _notes(df, key, payload).select(key, "note_status")


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _value_string(plain: Column) -> Column:
    """valueString if it is a string, or its text if that is one."""
    inner = F.try_variant_get(plain, "$.text", "variant")
    return F.when(_is_text(plain), F.try_variant_get(plain, "$", "string")).when(_is_text(inner), F.try_variant_get(plain, "$.text", "string"))


def _record(paths: Sequence[str], leaf: str = "string") -> str:
    """The struct type that holds these paths of an object."""
    names = list(dict.fromkeys(p.split(".")[1] for p in paths))
    below = {n: [p.replace(f".{n}", "", 1) for p in paths if p.startswith(f"$.{n}.")] for n in names}
    return f"struct<{', '.join(f'{n}: {_record(below[n]) if below[n] else leaf}' for n in names)}>"


def _ok(df: DataFrame, key: str, payload: str | None) -> DataFrame:
    return _notes(df, key, payload).where("note_status = 'ok'")


def _resources(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, resource_index, _o): the objects among the elements of ok notes as `record`; the index counts all elements, from 0.

    An object is read in one pass, whatever the number of its fields; a field of another kind than the
    record's is null. It is read before the array is opened, where no filter can have it read again.
    """
    read = F.transform("items", lambda r: F.try_variant_get(r, "$", record))
    each = _ok(df, key, None).select(key, F.posexplode(read).alias("resource_index", "_o"))
    return each.where("_o IS NOT NULL").withColumn("resource_index", F.col("resource_index").cast("bigint"))


def _read(df: DataFrame, key: str, payload: str, record: str) -> DataFrame:
    """As _resources(), from texts, with no variant of an element between; a text that the strict reader refuses is a row of its own, in `_refused`."""
    text = F.col(payload)
    some = text.isNotNull() & (text != "")
    each = df.select(F.col(key), F.when(some, text).alias("_text")).withColumn("_doc", strict_items(F.col("_text"), record))
    each = each.select(key, F.col("_doc.items").alias("_items"), F.when(F.col("_doc").isNull(), F.col("_text")).alias("_refused"))
    each = each.select(key, "_refused", F.posexplode_outer("_items").alias("resource_index", "_o")).where("_o IS NOT NULL OR _refused IS NOT NULL")
    return each.withColumn("resource_index", F.col("resource_index").cast("bigint"))


def codes(df: DataFrame, key: str, payload: str | None = None, both_schedules: bool = False, columns: Sequence[str] = CODES, numbers: Sequence[str] = ()) -> DataFrame:
    """key and the flat columns of every resource of an array, `numbers` among them in their normal form.

    both_schedules also reads schedule_info as the extraction contract spells it; only `columns` are read.
    Texts are read straight to the record and the columns written once, with the texts that the reader refused beside
    them; only those are parsed on their own, if there are any.
    """
    paths = {name: path for name, path in CODE_PATHS.items() if name in columns}
    spelt = ["$.schedule_info"] if both_schedules and "schedule_info" in columns else []
    record = _record([*paths.values(), *spelt])
    if "valueString" in columns:
        record = f"{record[:-1]}{', ' if paths else ''}valueString: variant>"
    field = {name: F.col(path.replace("$", "_o", 1)) for name, path in paths.items()}
    field |= {"resource_index": F.col("resource_index")}
    if "valueString" in columns:
        field["valueString"] = _value_string(F.col("_o.valueString"))
    if spelt:
        field["schedule_info"] = F.coalesce(field["schedule_info"], F.col("_o.schedule_info"))
    if payload is None:
        found = _resources(df, key, record).select(key, *[field[c].alias(c) for c in columns])
        return normalized(found, numbers) if numbers else found
    flat = _read(df, key, payload, record).select(key, *[field[c].alias(c) for c in columns], "_refused")
    rows = written(flat.withColumn("_normal", _all_normal(numbers)), "codes", **PLAIN)
    found = _settled(rows.where("_refused IS NULL").drop("_refused"), numbers)
    refused = rows.where("_refused IS NOT NULL")
    if refused.isEmpty():
        return found
    return found.unionByName(codes(parsed(refused.select(key, "_refused"), key, "_refused"), key, None, both_schedules, columns, numbers))


def normalized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the normal form of these values, written once: only rows with a value in another form go on to be normalized, if there are any."""
    return _settled(written(df.withColumn("_normal", _all_normal(columns)), "values"), columns)


def _all_normal(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [is_normal(F.col(c)) for c in columns], F.lit(True))


def _settled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Written rows without `_normal`; those where it is false with the normal form of `columns`."""
    others = rows.where("NOT _normal")
    if others.isEmpty():
        return rows.drop("_normal")
    return rows.where("_normal").unionByName(others.withColumns({c: normalize_value(F.col(c)) for c in columns})).drop("_normal")


_OWNER = ["note_key", "src_resource_index", "src_resourceType", "src_id"]

#: The schema of an object that holds a reference and nothing else.
_SOLE = "OBJECT<reference: STRING>"


def _met(nodes: DataFrame, path: Column, value: Column, named: Column) -> DataFrame:
    """Nodes at path, whose member reference is `named`: those that hold a string there and nothing else are done and keep no value."""
    sole = F.when(named.isNotNull(), F.schema_of_variant(value) == _SOLE)
    found = nodes.withColumns({"path": path, "node": value, "found": F.when(sole, F.try_variant_get(named, "$", "string"))})
    met = {"node": F.when(F.col("found").isNull(), F.col("node")), "target_ref": F.coalesce("target_ref", "found"), "done": F.col("done") | F.col("found").isNotNull()}
    return found.withColumns(met).select(*nodes.columns)


def _may_hold(value: Column) -> Column:
    """Whether a member named reference may lie in value: its schema names it, or leaves out elements that are unlike."""
    schema = F.replace(F.schema_of_variant(value), F.lit("VARIANT"), F.lit("reference"))  # named once, as it is costly
    return F.contains(schema, F.lit("reference"))


def _deeper(nodes: DataFrame, prune: bool) -> DataFrame:
    """The members and elements of all nodes; what is done stays as it is, and a scalar ends. prune leaves out what holds no reference."""
    below = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode_outer(F.col("node").outer()))
    below = below.where(F.col("done") | (F.col("value").isNotNull() & (_may_hold(F.col("value")) if prune else F.lit(True))))
    step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).when(F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.lit(""))
    # read with its object: a path that is not there costs an exception a node
    named = F.try_variant_get("value", "$", "struct<reference: variant>")["reference"]
    return _met(below, F.concat("path", step), F.col("value"), named).select(*nodes.columns)


def _walk(df: DataFrame, key: str, payload: str | None, own: Sequence[str], rows: bool) -> tuple[DataFrame, DataFrame | None]:
    """(edges, resources): the edges as refs(), with `own` columns of the resource that holds them; with rows the resources too, of the same columns.

    Texts are read straight to nodes. A pass walks several levels in one stage and writes what it met, the nodes it has
    not opened yet and the texts that the reader refused; only those are parsed on their own, if there are any.
    """
    names = ("resourceType", "id", *own)
    record = f"{_record([CODE_PATHS[c] for c in names])[:-1]}, reference: variant>"
    if payload is None:
        each = _ok(df, key, None).select(key, F.lit(None).cast("string").alias("_refused"), F.posexplode("items").alias("resource_index", "_o"))
    else:
        each = _read(df, key, payload, "variant")
    each = each.withColumn("_read", F.try_variant_get("_o", "$", record))
    owner = [*_OWNER, *(f"src_{c}" for c in own)]
    shown = [F.col(key), F.col("resource_index").cast("bigint"), *(F.col(CODE_PATHS[c].replace("$", "_read", 1)) for c in names)]
    # what is no object has neither node nor end and is left out at the first level: a filter here would have each object read again
    ends, opened = F.col("_refused").isNotNull(), F.col("_read").isNotNull()
    if rows:
        each = each.withColumn("_row", F.explode(F.when(opened, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        ends, opened = ends | F.col("_row"), opened & ~F.col("_row")
    roots = each.select(*[c.alias(n) for c, n in zip(shown, owner, strict=True)], F.lit("$").alias("path"), F.when(opened, F.col("_o")).alias("node"), F.when(opened, F.col("_read.reference")).alias("_named"), F.lit(None).cast("string").alias("target_ref"), "_refused", ends.alias("done"))
    nodes = _met(roots, F.col("path"), F.col("node"), F.col("_named")).drop("_named")
    levels, passes = FIRST_LEVELS, []
    while True:
        for level in range(1, levels + 1):
            nodes = _deeper(nodes, prune=level & (level - 1) == 0)
        walked = written(nodes.where("done OR node IS NOT NULL"), "edges")
        passes.append(walked)
        nodes, levels = walked.where("NOT done"), min(2 * levels, MOST_LEVELS)
        if nodes.isEmpty():
            break
    named = [F.col("note_key").alias(key), *owner[1:]]
    target = split_ref(F.col("target_ref"))
    relation = F.when(F.contains("path", F.lit(".evidence")), F.lit("evidence"))
    edges = reduce(DataFrame.unionByName, [p.where("target_ref IS NOT NULL") for p in passes])
    edges = edges.select(*named, "path", relation.alias("relation"), "target_ref", target["type"].alias("target_type"), target["id"].alias("target_id"))
    resources = passes[0].where("done AND target_ref IS NULL AND _refused IS NULL").select(*named) if rows else None
    refused = passes[0].where("_refused IS NOT NULL").select(F.col("note_key").alias(key), "_refused")
    if payload is None or refused.isEmpty():
        return edges, resources
    others, their = _walk(parsed(refused, key, "_refused"), key, None, own, rows)
    return edges.unionByName(others), resources.unionByName(their) if rows else None


def refs(df: DataFrame, key: str, payload: str | None = None, own: Sequence[str] = ()) -> DataFrame:
    """key and an edge for every object that holds a reference and nothing else, at any depth.

    `own` are further columns of CODES, here src_..., of the resource that holds the edge. A pass walks several levels in
    one stage; while nodes are left, another goes on from those. What holds no reference is left out at levels 1, 2, 4, 8
    and so on of a pass: a node's schema costs as much as all that lies below it.
    """
    return _walk(df, key, payload, own, rows=False)[0]


def named_refs(df: DataFrame, key: str, payload: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, resources): refs() and the NAMED columns of codes(), from texts that are read once for both."""
    edges, rows = _walk(df, key, payload, ["description"], rows=True)
    return edges.drop("src_description"), rows.select(key, *[F.col(f"src_{c}").alias(c) for c in NAMED])


def resolved_refs(edges: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """Edges with the index and description of the resource of the same note that they name, if any."""
    named = resources.select(key, F.col("id").alias("target_id"), F.col("resource_index").alias("target_index"), F.col("description").alias("target_description"))
    return edges.join(named, [key, "target_id"], "left")
