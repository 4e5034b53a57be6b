"""Queries over gold annotations: a user is a note, a kind of event an entity, events its data entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import gold
from notewright.plans.tables import scratch, table
from notewright.schemas import GOLD_ENTRY_FIELDS, GOLD_FIELDS
from notewright.sources import ranged


def entities(spark, sf_dir):
    """Rows of schemas.GOLD_ENTITY; an entity's entries are a user's events of one kind and day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    cell = "named_struct('tbl', '{t}', 'field', {f}, 'kind', '{k}', 'value', {v})"
    cells = [
        cell.format(t="labevents", f="'valuenum'", k="int", v="cast(cast(value as int) div 50 as string)"),
        cell.format(t="labevents", f="'value'", k="str", v="if(value < 50, 'NaN', cast(cast(value as int) div 50 as string))"),
        cell.format(t="chartevents", f="'value'", k="int", v="cast(cast(value as int) div 50 as string)"),
        cell.format(t="d_items", f="'route'", k="str", v="'ignored'"),
        cell.format(t="chartevents", f="'charttime'", k="str", v="day"),
        cell.format(t="outputevents", f="cast(null as string)", k="NoneType", v="cast(null as string)"),
        cell.format(t="label", f="'value'", k="str", v="'ignored'"),
    ]
    # each cell once, so that a table's cells stay together in document order
    events = e.select("user_id", "event_type", "day", F.struct("ts", "event_id", F.expr(f"array({', '.join(cells)})").alias("cells")).alias("x"))
    grouped = events.groupBy("user_id", "event_type", "day").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select(F.col("user_id").cast("string").alias("ROW_ID"), F.col("day").alias("position"), F.col("event_type").alias("entity_text"), F.lit("event").alias("entity_type"), F.when(F.col("event_type") != "signup", F.transform("xs", lambda x: x["cells"])).otherwise(F.array()).alias("data"))


def gold_flatten(spark, sf_dir):
    return gold.flatten(entities(spark, sf_dir))


def gold_entries(spark, sf_dir):
    return gold.flatten_entries(entities(spark, sf_dir))


def field_discovery(spark, sf_dir):
    return gold.discover(entities(spark, sf_dir))


def gold_from_files(spark, sf_dir):
    """gold_flatten of nested documents written to files and read back member by member."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("v", F.expr("cast(value as int) div 50"))
    entry = F.expr("""named_struct('labevents', named_struct('valuenum', v, 'value', if(value < 50, 'NaN', cast(v as string))), 'chartevents', named_struct('value', v, 'charttime', day),
      'd_items', named_struct('route', 'ignored'), 'outputevents', cast(map() as map<string,string>), 'label', named_struct('value', 'ignored'))""")
    grouped = e.groupBy("user_id", "event_type", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.to_json(entry).alias("entry")))).alias("xs"))
    data = F.when(F.col("event_type") != "signup", F.array_join("xs.entry", ", ")).otherwise(F.lit(""))
    name = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    line = F.concat(F.lit("{"), name("user_id"), F.lit(": [{"), name("event_type"), F.lit(': {"position": '), name("day"), F.lit(', "entity_type": "event", "data": ['), data, F.lit("]}}]}"))
    path = scratch(spark, "gold")
    grouped.select(line.alias("value")).write.text(path)
    return gold.flatten(ranged.gold_files(spark, path))


QUERIES = {f.__name__: f for f in (gold_flatten, gold_entries, field_discovery, gold_from_files)}

_CELLS = """e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, (value::DECIMAL(18,6)) AS d, trunc(value)::BIGINT // 50 AS v FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) AS i FROM e),
k AS (SELECT DISTINCT user_id, event_type, day FROM e)"""


def _joined(rows: str) -> str:
    """Distinct values of (kind, text, order) rows in order of appearance, of one entity."""
    return f"""(SELECT user_id, event_type, day, string_agg(t, ' | ' ORDER BY o) AS s FROM (SELECT user_id, event_type, day, kind, t, min(o) AS o FROM ({rows}) WHERE event_type <> 'signup' AND t IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


_VALUE = "SELECT user_id, event_type, day, 'str' AS kind, CASE WHEN value >= 50 THEN v::VARCHAR END AS t, 10 * i AS o FROM x UNION ALL SELECT user_id, event_type, day, 'int', v::VARCHAR, 10 * i + 1 FROM x"
_FLAT = {"value": _joined(_VALUE), "valuenum": _joined("SELECT user_id, event_type, day, 'int' AS kind, v::VARCHAR AS t, i AS o FROM x"), "charttime": _joined("SELECT user_id, event_type, day, 'str' AS kind, day AS t, i AS o FROM x")}
_NULLS = lambda fields, known: ", ".join(f"{known.get(f, 'NULL::VARCHAR')} AS {f}" for f in fields)

ORACLES = {
    "gold_flatten": f"""WITH {_CELLS} SELECT k.user_id::VARCHAR AS "ROW_ID", k.day AS position, k.event_type AS entity_text, 'event' AS entity_type, {_NULLS(GOLD_FIELDS, {f: f'j_{f}.s' for f in _FLAT})}
FROM k {' '.join(f'LEFT JOIN {q} j_{f} ON j_{f}.user_id = k.user_id AND j_{f}.event_type = k.event_type AND j_{f}.day = k.day' for f, q in _FLAT.items())}""",
    "gold_entries": f"""WITH {_CELLS} SELECT DISTINCT user_id::VARCHAR AS note_id, day AS position, event_type AS entity_text, 'event' AS entity_type,
  {_NULLS(GOLD_ENTRY_FIELDS, {'valuenum': "CASE WHEN event_type <> 'signup' THEN v::VARCHAR END", 'charttime': "CASE WHEN event_type <> 'signup' THEN day END"})} FROM x""",
    "field_discovery": """SELECT * FROM (VALUES ('labevents', 'valuenum'), ('labevents', 'value'), ('chartevents', 'value'), ('chartevents', 'charttime'), ('d_items', 'route'), ('outputevents', NULL)) AS t(tbl, field)
WHERE EXISTS (SELECT 1 FROM events WHERE event_type <> 'signup')""",
}
ORACLES["gold_from_files"] = ORACLES["gold_flatten"]
