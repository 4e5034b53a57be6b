"""Queries over the inference runtime, with a model that answers by rule."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from notewright.functions import budgets, prompts
from notewright.functions.jsontext import json_valid, merge_outputs
from notewright.operators import inference
from notewright.plans.tables import scratch, table

SERVERS = ("http://a", "http://b", "http://c")


class RuleModel:
    """Answers with the prompt's length, cut short where that takes more tokens than the budget; one server is down."""

    async def complete(self, server: str, prompt: str, max_tokens: int) -> str:
        if server == SERVERS[1]:
            raise ConnectionError(server)
        if prompt.endswith("."):
            raise ValueError("refused")
        answer = json.dumps([{"n": len(prompt)}])
        return answer if len(prompt) <= 2 * max_tokens else answer[:-2]


def _prompted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", "source", prompts.prompt("sharded", F.lit("2024-01-01"), F.col("text")).alias("prompt"))


def inference_attempts(spark, sf_dir):
    """State of every row after two attempts: the second takes only rows without a valid output, with twice the budget."""
    path, docs = scratch(spark, "attempts"), _prompted(spark, sf_dir)
    inference.run_attempt(docs, path, RuleModel, SERVERS, "doc_id")
    state = inference.run_attempt(docs, path, RuleModel, SERVERS, "doc_id")
    return state.select("doc_id", "concepts", "concepts_status", "concepts_error", "valid_output", "concepts_max_tokens")


def inference_failing_servers(spark, sf_dir):
    """Every row asked in rounds while one server is down: its answer, and whether it was asked at most three times."""
    asked = _prompted(spark, sf_dir).withColumn("tokens", F.lit(2048))
    done = inference.infer_in_rounds(asked, RuleModel, SERVERS, "doc_id", "prompt", "tokens", "concepts")
    return done.select("doc_id", "concepts", "concepts_status", "concepts_error", (F.col("concepts_attempts") <= inference.ATTEMPTS).alias("bounded"))


def _reported(spark, sf_dir):
    asked = _prompted(spark, sf_dir).withColumn("tokens", budgets.within_context(F.lit(0), F.col("prompt")))
    return inference.file_report(inference.infer(asked, RuleModel, SERVERS, "prompt", "tokens", "concepts"), "source")


def inference_report(spark, sf_dir):
    """Per source: rows, successes, errors."""
    return _reported(spark, sf_dir)


def inference_totals(spark, sf_dir):
    return inference.totals(_reported(spark, sf_dir))


def resume_merge(spark, sf_dir):
    """Previous results of valid rows over a new state of all rows."""
    events = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    before = events.where(F.col("event_type") != "click").select("event_id", F.col("props").alias("concepts"), F.lit("success").alias("concepts_status"), F.lit(None).cast("string").alias("concepts_error"), ok.alias("valid_output"), F.col("user_id").alias("concepts_max_tokens"))
    return inference.resume(events.select("event_id", "ts"), before, "event_id", "concepts", "valid_output").drop("ts")


def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


def _damaged():
    return F.expr("CASE event_type WHEN 'error' THEN substr(props, 1, 3) WHEN 'purchase' THEN concat(props, ' x') WHEN 'signup' THEN NULL ELSE props END")


def json_validity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", json_valid(_damaged()).alias("valid"))


def merge_chunk_outputs(spark, sf_dir):
    """Arrays joined, objects appended; a damaged piece instead of the whole."""
    done = merge_outputs(F.array("props", F.concat(F.lit("["), F.col("props"), F.lit(", 1]")), F.coalesce(_damaged(), F.lit(""))))
    return table(spark, sf_dir, "events").select("event_id", done["text"].alias("text"), done["valid"].alias("valid"))


QUERIES = {f.__name__: f for f in (inference_attempts, inference_failing_servers, inference_report, inference_totals, resume_merge, json_field, json_validity, merge_chunk_outputs)}

_BEFORE, _AFTER = (s.replace("'", "''") for s in prompts.SHARDED)
_PROMPTED = f"a AS (SELECT doc_id, source, '{_BEFORE}2024-01-01{_AFTER}' || text AS prompt FROM documents), b AS (SELECT *, length(prompt) AS n, prompt LIKE '%.' AS refused FROM a)"
_REPORT = f"WITH {_PROMPTED}, r AS (SELECT source, count(*) AS total, count_if(NOT refused)::BIGINT AS success, count_if(refused)::BIGINT AS errors FROM b GROUP BY source)"

ORACLES = {
    "inference_attempts": f"""WITH {_PROMPTED} SELECT doc_id, CASE WHEN NOT refused THEN '[{{"n": ' || n || CASE WHEN n <= 8192 THEN '}}]' ELSE '' END END AS concepts, CASE WHEN refused THEN 'error' ELSE 'success' END AS concepts_status,
  CASE WHEN refused THEN 'refused' END AS concepts_error, NOT refused AND n <= 8192 AS valid_output, CASE WHEN NOT refused AND n <= 4096 THEN 2048 ELSE 4096 END::BIGINT AS concepts_max_tokens FROM b""",
    "inference_failing_servers": f"""WITH {_PROMPTED} SELECT doc_id, CASE WHEN NOT refused THEN '[{{"n": ' || n || CASE WHEN n <= 4096 THEN '}}]' ELSE '' END END AS concepts, CASE WHEN refused THEN 'error' ELSE 'success' END AS concepts_status,
  CASE WHEN refused THEN 'refused' END AS concepts_error, true AS bounded FROM b""",
    "inference_report": f"{_REPORT} SELECT * FROM r",
    "inference_totals": f"{_REPORT} SELECT count(*) AS n_files, sum(total)::BIGINT AS total, sum(success)::BIGINT AS success, sum(errors)::BIGINT AS errors FROM r",
    "resume_merge": """SELECT event_id, CASE WHEN ok THEN props END AS concepts, CASE WHEN ok THEN 'success' END AS concepts_status, NULL::VARCHAR AS concepts_error, ok AS valid_output, CASE WHEN event_type <> 'click' THEN user_id ELSE 0 END AS concepts_max_tokens
FROM (SELECT *, event_type NOT IN ('click', 'error') AS ok FROM events)""",
    "json_field": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events",
    "json_validity": "SELECT event_id, event_type NOT IN ('error', 'purchase', 'signup') AS valid FROM events",
    "merge_chunk_outputs": """SELECT event_id, CASE event_type WHEN 'error' THEN substring(props, 1, 3) WHEN 'purchase' THEN props || ' x' WHEN 'signup' THEN '' ELSE '[' || props || ', ' || props || ', 1, ' || props || ']' END AS text, event_type NOT IN ('error', 'purchase', 'signup') AS valid FROM events""",
}
