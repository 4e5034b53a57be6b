"""Second pass over rows without a valid output: cut the text, ask for each piece, merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.jsontext import json_strings, merge_outputs
from notewright.functions.prompts import prompt
from notewright.functions.text import CHUNK_CHARS, MOST_CHUNKS, chunks
from notewright.operators.inference import IN_FLIGHT, ModelClient, infer
from notewright.operators.prepare import with_defaults
from notewright.schemas import RETRY_STATE


def todo(df: DataFrame, valid: str = "valid_output") -> DataFrame:
    """Rows that failed the first pass and have not been resolved since."""
    return df.where(~F.col(valid) & ~F.col("retry_valid"))


def resume(df: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """df with the six retry columns of previous where they are valid there."""
    old = previous.where("retry_valid").select(key, F.lit(True).alias("_done"), *[F.col(c).alias(f"_{c}") for c in RETRY_STATE])
    joined = with_defaults(df, RETRY_STATE).join(old, key, "left")
    return joined.withColumns({c: F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)) for c in RETRY_STATE}).drop("_done", *[f"_{c}" for c in RETRY_STATE])


def pieces(df: DataFrame, key: str, date: str, text: str, chars: int = CHUNK_CHARS, most: int = MOST_CHUNKS) -> DataFrame:
    """(key, piece, prompt): a prompt for each piece of each row's text."""
    cut = df.select(key, F.coalesce(F.col(date).cast("string"), F.lit("None")).alias("_date"), F.posexplode(chunks(F.col(text), chars, most)).alias("piece", "_text"))
    return cut.select(key, "piece", prompt("retry", F.col("_date"), F.col("_text")).alias("prompt"))


def merged(answers: DataFrame, key: str) -> DataFrame:
    """(key, retry columns) of (key, piece, prompt, output); a row has at most MOST_CHUNKS pieces."""
    row = F.struct("piece", F.coalesce("output", F.lit("")).alias("output"), "prompt")
    per_row = answers.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_p"))
    outputs, prompts = F.transform("_p", lambda p: p["output"]), F.transform("_p", lambda p: p["prompt"])
    done = per_row.select(key, F.size("_p").cast("long").alias("retry_chunks"), merge_outputs(outputs).alias("_m"), json_strings(outputs).alias("retry_chunk_outputs"), json_strings(prompts).alias("retry_prompt"))
    return done.select(key, F.col("_m.text").alias("retry_output"), F.col("_m.valid").alias("retry_valid"), "retry_chunks", "retry_chunk_outputs", "retry_prompt", (~F.col("_m.valid")).alias("retry_exhausted"))


def retry(
    df: DataFrame,
    connect: Callable[[], ModelClient],
    servers: Sequence[str],
    key: str,
    date: str,
    text: str,
    valid: str = "valid_output",
    max_tokens: int = 2048,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """(key, retry columns) of every row still to be resolved.

    A text with nothing but blank pieces has none to ask for and counts as an empty, valid array.
    Write the result before reading it twice: it holds the model's answers.
    """
    open_ = todo(with_defaults(df, RETRY_STATE), valid)
    asked = pieces(open_, key, date, text).withColumn("max_tokens", F.lit(max_tokens))
    answers = infer(asked, connect, servers, "prompt", "max_tokens", "output", in_flight)
    found = merged(answers.select(key, "piece", "prompt", "output"), key)
    empty = {"retry_output": "[]", "retry_valid": True, "retry_chunks": 0, "retry_chunk_outputs": "[]", "retry_prompt": "[]", "retry_exhausted": False}
    return open_.select(key).join(found, key, "left").select(key, *[F.when(F.col("retry_chunks").isNull(), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in empty.items()])


def applied(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """df with the retry columns of the rows that results has."""
    new = results.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in RETRY_STATE])
    joined = with_defaults(df, RETRY_STATE).join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in RETRY_STATE}).drop("_new", *[f"_{c}" for c in RETRY_STATE])


def overall(df: DataFrame, out: str = "concepts", valid: str = "valid_output") -> DataFrame:
    """df with overall_output and overall_valid: the first pass where valid, else the retry; null and false if neither ran."""
    ok = F.col(valid)
    return df.withColumns({"overall_output": F.when(ok, F.col(out)).when(~ok, F.col("retry_output")), "overall_valid": F.coalesce(F.when(ok, F.lit(True)).when(~ok, F.col("retry_valid")), F.lit(False))})


def report(df: DataFrame, valid: str = "valid_output") -> DataFrame:
    """One row: totals, first-pass results, and what the retry resolved or exhausted."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        n(F.col(valid)).alias("n_initial_ok"),
        n(~F.col(valid)).alias("n_failed"),
        n(F.col("retry_valid")).alias("n_retry_ok"),
        n(F.col("retry_exhausted")).alias("n_exhausted"),
        n(F.col("overall_valid")).alias("n_overall_ok"),
    )


def chunk_histogram(df: DataFrame, valid: str = "valid_output") -> DataFrame:
    """(retry_chunks, n) over the rows that failed the first pass."""
    return df.where(~F.col(valid)).groupBy("retry_chunks").agg(F.count(F.lit(1)).alias("n")).orderBy("retry_chunks")
