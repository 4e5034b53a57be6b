"""Queries over the second pass: pieces of long texts, merged answers, overall results."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from notewright.functions import prompts, text
from notewright.operators import retry
from notewright.plans.tables import scratch, table

_DATE = "2024-01-01"
#: Code points of a retry prompt apart from the text.
_FRAME = sum(map(len, prompts.RETRY)) + len(_DATE)


def _texts(spark, sf_dir):
    """Documents with blank lines after some of their lines."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.replace("text", F.lit(",\n"), F.lit(",\n\n")).alias("text"))


def chunk_counts(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", text.chunk_number(F.col("text")).alias("n_planned"), F.size(text.chunks(F.col("text"))).alias("n_pieces"))


def chunk_text(spark, sf_dir):
    pieces = _texts(spark, sf_dir).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("piece", "chunk"))
    return pieces.select("doc_id", "piece", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


class LengthModel:
    """Answers with the length of the piece, or with half an array where that ends in a mark."""

    async def complete(self, server: str, prompt: str, max_tokens: int) -> str:
        return json.dumps([len(prompt) - _FRAME]) if not prompt.endswith(",") else "["


def _failed(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.lit(_DATE).alias("date"), "text", (F.col("lang") == "en").alias("valid_output"), F.lit("[]").alias("concepts"))


def _retried(spark, sf_dir):
    docs, path = _failed(spark, sf_dir), scratch(spark, "retry")
    retry.retry(docs, LengthModel, ["http://a"], "doc_id", "date", "text").write.parquet(path)
    return retry.overall(retry.applied(docs, spark.read.parquet(path), "doc_id"))


def retry_rows(spark, sf_dir):
    """What the second pass makes of every row that failed the first."""
    found = _retried(spark, sf_dir)
    return found.select("doc_id", "retry_output", "retry_valid", "retry_chunks", F.md5("retry_chunk_outputs").alias("outputs_md5"), "retry_exhausted", "overall_output", "overall_valid")


def _flagged(spark, sf_dir):
    """A state of rows as a second pass leaves it, made from orders."""
    o = table(spark, sf_dir, "orders")
    valid = F.expr("CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END")
    tried = F.col("o_orderstatus") == "O"
    return o.select("o_orderkey", valid.alias("valid_output"), F.col("o_orderpriority").alias("concepts"), F.when(tried, F.concat(F.lit("again "), "o_orderpriority")).alias("retry_output"), (tried & (F.col("o_orderpriority") < "3")).alias("retry_valid"), (F.col("o_custkey") % 16).alias("retry_chunks"), (tried & (F.col("o_orderpriority") >= "3")).alias("retry_exhausted"))


def compute_overall(spark, sf_dir):
    return retry.overall(_flagged(spark, sf_dir)).select("o_orderkey", "overall_output", "overall_valid")


def retry_report(spark, sf_dir):
    return retry.report(retry.overall(_flagged(spark, sf_dir)))


def retry_todo(spark, sf_dir):
    return retry.todo(_flagged(spark, sf_dir)).select("o_orderkey")


def chunk_histogram(spark, sf_dir):
    return retry.chunk_histogram(_flagged(spark, sf_dir))


QUERIES = {f.__name__: f for f in (chunk_counts, chunk_text, retry_rows, compute_overall, retry_report, retry_todo, chunk_histogram)}

#: Pieces by recursion: each step cuts one off, the last step takes what is left.
_PIECES = r"""RECURSIVE d AS (SELECT doc_id, lang, replace(text, E',\n', E',\n\n') AS text FROM documents),
p AS (SELECT *, CASE WHEN length(text) <= 4000 THEN 1 ELSE least(16, greatest(2, length(text) // 4001 + 1)) END::INT AS planned FROM d),
s AS (SELECT doc_id, 0 AS step, NULL::VARCHAR AS head, text AS rest, planned, (length(text) // planned)::INT AS size FROM p
  UNION ALL SELECT doc_id, step + 1, CASE WHEN cut < 0 THEN rest ELSE left(rest, cut) END, CASE WHEN cut < 0 THEN '' ELSE ltrim(substring(rest, cut + 1), E'\n') END, planned, size FROM (
    SELECT *, CASE WHEN step + 1 = planned OR size >= length(rest) THEN -1 WHEN contains(left(rest, size), E'\n\n') THEN size - strpos(reverse(left(rest, size)), E'\n\n') - 1
      WHEN contains(left(rest, size), E'\n') THEN size - strpos(reverse(left(rest, size)), E'\n') ELSE -1 END::INT AS cut FROM s WHERE step < planned AND rest <> '')),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step)::INT - 1 AS piece, head AS chunk FROM s WHERE step > 0 AND (planned = 1 OR regexp_matches(head, '\S')))"""
_FLAGS = """f AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey % 16 AS retry_chunks, o_orderstatus = 'F' AS first_ok, o_orderstatus = 'O' AS tried, o_orderstatus = 'O' AND o_orderpriority < '3' AS again_ok FROM orders)"""

ORACLES = {
    "chunk_counts": f"WITH {_PIECES} SELECT doc_id, planned AS n_planned, coalesce(n, 0)::INT AS n_pieces FROM p LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id)",
    "chunk_text": f"WITH {_PIECES} SELECT doc_id, piece, length(chunk)::INT AS n_chars, md5(chunk) AS chunk_md5 FROM c",
    "retry_rows": f"""WITH {_PIECES}, a AS (SELECT doc_id, piece, CASE WHEN chunk LIKE '%,' THEN '[' ELSE '[' || length(chunk) || ']' END AS answer, length(chunk) AS n FROM c),
r AS (SELECT doc_id, bool_and(answer <> '[') AS ok, CASE WHEN bool_and(answer <> '[') THEN '[' || string_agg(n, ', ' ORDER BY piece) || ']' ELSE '[' END AS merged, count(*) AS n, md5('[' || string_agg('"' || answer || '"', ', ' ORDER BY piece) || ']') AS m FROM a GROUP BY doc_id)
SELECT doc_id, CASE WHEN lang <> 'en' THEN merged END AS retry_output, lang <> 'en' AND ok AS retry_valid, CASE WHEN lang <> 'en' THEN n ELSE 0 END AS retry_chunks, CASE WHEN lang <> 'en' THEN m END AS outputs_md5, lang <> 'en' AND NOT ok AS retry_exhausted,
  CASE WHEN lang = 'en' THEN '[]' ELSE merged END AS overall_output, lang = 'en' OR ok AS overall_valid FROM p JOIN r USING (doc_id)""",
    "compute_overall": f"WITH {_FLAGS} SELECT o_orderkey, CASE WHEN first_ok THEN o_orderpriority WHEN tried THEN 'again ' || o_orderpriority END AS overall_output, first_ok OR again_ok AS overall_valid FROM f",
    "retry_report": f"WITH {_FLAGS} SELECT count(*) AS n_total, count_if(first_ok)::BIGINT AS n_initial_ok, count_if(tried)::BIGINT AS n_failed, count_if(again_ok)::BIGINT AS n_retry_ok, count_if(tried AND NOT again_ok)::BIGINT AS n_exhausted, count_if(first_ok OR again_ok)::BIGINT AS n_overall_ok FROM f",
    "retry_todo": f"WITH {_FLAGS} SELECT o_orderkey FROM f WHERE tried AND NOT again_ok",
    "chunk_histogram": f"WITH {_FLAGS} SELECT retry_chunks, count(*) AS n FROM f WHERE tried GROUP BY retry_chunks",
}
