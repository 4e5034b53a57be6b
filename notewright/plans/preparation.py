"""Queries over corpus preparation, prompts and normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import budgets, ids, prompts, text, values
from notewright.operators import prepare
from notewright.plans.tables import scratch, table
from notewright.sources import ranged
from notewright.sources import sinks


def dedup_keep_first(spark, sf_dir):
    """Texts of documents, then of benchmark, each once."""
    shards = [
        table(spark, sf_dir, "documents").select(F.lit(0).alias("shard"), F.col("doc_id").alias("row"), "text"),
        table(spark, sf_dir, "benchmark").select(F.lit(1).alias("shard"), F.col("item_id").alias("row"), "text"),
    ]
    found = prepare.dedupe_keep_first(prepare.union(*shards), "text", ["shard", "row"])
    return found.select("shard", "row", F.md5("text").alias("text_md5"))


def _split(spark, sf_dir):
    return prepare.group_split(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey")


def group_split(spark, sf_dir):
    return _split(spark, sf_dir)


def group_split_report(spark, sf_dir):
    return prepare.split_report(_split(spark, sf_dir), "o_custkey")


def group_split_overlap(spark, sf_dir):
    return prepare.split_overlap(_split(spark, sf_dir), "o_custkey")


def sample_exact_n(spark, sf_dir):
    """100 documents, always the same."""
    return prepare.sample_exact(table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars"), "doc_id", 100)


def _dated(spark, sf_dir):
    day = F.expr("timestamp_ntz'2020-01-01 08:30:00' + make_dt_interval(cast(doc_id % 1000 as int))")
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumn("at", day)


def _prompts(style, date):
    def query(spark, sf_dir):
        return _dated(spark, sf_dir).select("doc_id", F.md5(prompts.prompt(style, date(F.col("at")), F.col("text")).cast("binary")).alias("prompt_md5"))

    return query


PROMPTS = {
    "build_prompts_training": _prompts("training", lambda at: F.date_format(at, "yyyy-MM-dd")),
    "build_prompts_first_pass": _prompts("first_pass", text.prompt_date),
    "build_prompts_retry": _prompts("retry", text.prompt_date),
    "build_prompts_sharded": _prompts("sharded", lambda at: text.note_day(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.col("doc_id") % 30)),
}


def note_days(spark, sf_dir):
    """Days of event times, moved; times cut short can't be read."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    time = F.when(F.col("event_type") == "error", F.substring(at, 1, 7)).when(F.col("event_type") == "purchase", F.substring(at, 1, 10)).otherwise(at)
    return table(spark, sf_dir, "events").select("event_id", text.note_day(time, F.col("user_id") % 50).alias("day"))


def training_lines(spark, sf_dir):
    """JSON lines of training pairs."""
    pairs = prepare.training_pairs(_dated(spark, sf_dir), F.date_format("at", "yyyy-MM-dd"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    return sinks.line_of(pairs).select(F.md5("value").alias("line_md5"))


def normalize_texts(spark, sf_dir):
    padded = F.concat(F.lit(" \t "), F.when(F.col("c_acctbal") > 0, F.upper("c_mktsegment")).otherwise(F.lit("\n")), F.lit("\r\n "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_text(padded).alias("segment"))


def normalize_values(spark, sf_dir):
    """Numbers as texts of many shapes."""
    price, n = F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.col("l_linenumber")
    shape = (
        F.when(n == 1, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(n == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".00")))
        .when(n == 3, F.concat(F.lit("-"), price, F.lit("0")))
        .when(n == 4, F.concat(price, F.lit(" MG")))
        .when(n == 5, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("e2")))
        .when(n == 6, F.concat(F.lit("Line "), F.col("l_returnflag")))
        .otherwise(F.lit(" "))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.normalize_value(shape).alias("value"), values.normalize_number(F.col("l_quantity")).alias("quantity"))


def token_budgets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").withColumn("last", F.col("n_chars") % 5 * 2048)
    return docs.select("doc_id", budgets.within_context(F.col("last"), F.col("text")).alias("within_context"), budgets.doubled(F.col("last")).alias("doubled"))


def split_refs(spark, sf_dir):
    ref = F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.lit("/")), F.lit("r"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"))
    part = ids.split_ref(ref)
    return table(spark, sf_dir, "orders").select("o_orderkey", part["type"].alias("type"), part["id"].alias("id"))


def check_ids(spark, sf_dir):
    x = F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("R")).otherwise(F.lit("r")), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("\n")).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.is_valid_id(x).alias("valid"), ids.parse_id(x)["row"].alias("row"), ids.parse_id(x)["number"].alias("number"))


def union_category(spark, sf_dir):
    """Documents and conversations together, by category; columns that one lacks are null."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), "text", "lang")
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("category"), "text", "turn")
    both = prepare.union(docs, turns)
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"), F.count("turn").alias("n_turn"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


def unique_rows(spark, sf_dir):
    """Distinct rows on some columns, all of whose columns are kept alike."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return prepare.dedupe_rows(rows)


def shards_of_unlike_columns(spark, sf_dir):
    """Documents written in three shards, one without a language and one with counts as text, read back as declared."""
    path, docs = scratch(spark, "shards"), table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    shard = F.pmod(F.col("doc_id"), F.lit(3))  # every document goes to one of them
    forms = docs, docs.drop("lang"), docs.withColumn("n_chars", F.when(F.col("lang") == "de", F.lit("many")).otherwise(F.col("n_chars").cast("string"))).withColumn("more", F.lit(1))
    for i, form in enumerate(forms):
        form.where(shard == i).write.parquet(f"{path}/shard{i}")
    return ranged.declared_shards(spark, path, "doc_id long, lang string, n_chars long", {"lang": "unknown"}).drop("file_path")


QUERIES = {f.__name__: f for f in (dedup_keep_first, group_split, group_split_report, group_split_overlap, sample_exact_n, note_days, training_lines, normalize_texts, normalize_values, token_budgets, split_refs, check_ids, union_category, unique_rows, shards_of_unlike_columns)} | PROMPTS

_SPLIT = """g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey), o_custkey) <= floor(0.8::DOUBLE * count(*) OVER ()) AS train FROM g),
s AS (SELECT o_orderkey, o_custkey, CASE WHEN train THEN 'train' ELSE 'eval' END AS split FROM orders LEFT JOIN r USING (o_custkey))"""
_DATED = "d AS (SELECT doc_id, text, TIMESTAMP '2020-01-01 08:30:00' + to_days((doc_id % 1000)::INT) AS seen FROM documents)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(style: str, date: str) -> str:
    before, after = map(_quoted, prompts.STYLES[style])
    return f"WITH {_DATED} SELECT doc_id, md5({before} || {date} || {after} || text) AS prompt_md5 FROM d"


def _json(s: str) -> str:
    return f"CASE WHEN {s} IS NULL THEN 'null' ELSE to_json({s})::VARCHAR END"


_TRAINING = f"{_quoted(prompts.TRAINING[0])} || strftime(seen, '%Y-%m-%d') || {_quoted(prompts.TRAINING[1])} || text"
_PRICE, _NUMBER = "l_extendedprice::DECIMAL(12,2)::VARCHAR", "CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END"

ORACLES = {
    "dedup_keep_first": """SELECT shard, row, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY shard, row) AS rn FROM (
    SELECT 0 AS shard, doc_id AS row, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)) WHERE rn = 1""",
    "group_split": f"WITH {_SPLIT} SELECT * FROM s",
    "group_split_report": f"WITH {_SPLIT} SELECT split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM s GROUP BY split",
    "group_split_overlap": f"WITH {_SPLIT} SELECT o_custkey FROM s WHERE split = 'train' INTERSECT SELECT o_custkey FROM s WHERE split = 'eval'",
    "sample_exact_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "build_prompts_training": _prompt_sql("training", "strftime(seen, '%Y-%m-%d')"),
    "build_prompts_first_pass": _prompt_sql("first_pass", "strftime(seen, '%Y-%m-%d %H:%M:%S')"),
    "build_prompts_retry": _prompt_sql("retry", "strftime(seen, '%Y-%m-%d %H:%M:%S')"),
    "build_prompts_sharded": _prompt_sql("sharded", "strftime(seen + to_days((doc_id % 30)::INT), '%Y-%m-%d')"),
    "note_days": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE strftime(ts + to_days((user_id % 50)::INT), '%Y-%m-%d') END AS day FROM events",
    "training_lines": f"""WITH {_DATED}, p AS (SELECT {_TRAINING} AS input, CASE WHEN doc_id % 2 = 0 THEN text END AS output FROM d)
SELECT md5('{{"input":' || {_json('input')} || ',"output":' || {_json('output')} || '}}') AS line_md5 FROM p""",
    "normalize_texts": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS segment FROM customer",
    "normalize_values": f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_returnflag, CASE l_linenumber WHEN 1 THEN {_PRICE} WHEN 2 THEN l_quantity::INT::VARCHAR || '.00' WHEN 3 THEN '-' || {_PRICE} WHEN 5 THEN (l_quantity::INT * 100)::VARCHAR END::DOUBLE AS x,
  CASE l_linenumber WHEN 4 THEN {_PRICE} || ' mg' WHEN 6 THEN 'line ' || lower(l_returnflag) END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce({_NUMBER}, s) AS value, {_NUMBER.replace('x', 'q')} AS quantity FROM v""",
    "token_budgets": """WITH d AS (SELECT doc_id, length(text) AS n, n_chars % 5 * 2048 AS last FROM documents)
SELECT doc_id, CASE WHEN last > 0 THEN greatest(512, least(2 * last, 16384 - n // 4 - 256)) ELSE 2048 END AS within_context, CASE WHEN last > 0 THEN least(2 * last, 16384) ELSE 2048 END AS doubled FROM d""",
    "split_refs": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' THEN o_orderstatus END AS type,
  CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' THEN 'r' || o_custkey || '_' || o_orderkey END AS id FROM orders""",
    "check_ids": """SELECT o_orderkey, ok AS valid, CASE WHEN ok THEN o_custkey END AS row, CASE WHEN ok THEN o_orderkey END AS number
FROM (SELECT *, o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AS ok FROM orders)""",
    "union_category": """SELECT category, count(*) AS n, count(lang) AS n_lang, count(turn) AS n_turn, sum(length(text))::BIGINT AS n_chars FROM (
  SELECT source AS category, text, lang, NULL::BIGINT AS turn FROM documents UNION ALL SELECT role, text, NULL, turn FROM conversations) GROUP BY category""",
    "unique_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem",
}
ORACLES["shards_of_unlike_columns"] = """SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'unknown' ELSE lang END AS lang, CASE WHEN doc_id % 3 <> 2 OR lang <> 'de' THEN n_chars END AS n_chars FROM documents"""
