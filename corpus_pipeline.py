"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet to the shared folder and gives the next stage what was written. All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import language_id, mixing, packing, parity_join, secret_scan
from notewright.llm.common import held_out, shared_folder


def _row(docs: DataFrame):
    """A document with all its columns as one, out of reach of an operator's own names."""
    return F.struct(*docs.columns).alias("whole_row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is clear; the model is learnt from labelled rows of docs."""
    model = language_id.fit(docs.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(True))))
    found = language_id.predict(docs.select(_row(docs), "text"), model)
    return found.where(~F.col("rejected")).select("whole_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of linked documents the one of least doc_id, and of equal rows one.

    A document without an id goes only if its text equals one that has one.
    """
    key = ["known_id", "id_of", "text_key"]

    def keyed(df: DataFrame, *columns) -> DataFrame:  # no key is null, so that one shuffle serves the join and the equal rows
        return df.select(F.col("doc_id").isNotNull().alias("known_id"), F.coalesce("doc_id", F.lit(0)).alias("id_of"), *columns)

    found = parity_join.join(docs)
    gone = keyed(found.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))), "text_key")
    rows = keyed(docs, parity_join.text_key(F.col("text")).alias("text_key"), _row(docs))
    return rows.join(gone, key, "left_anti").dropDuplicates(key).select("whole_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a placeholder for each secret, linked parts included."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects the documents that fill the token budget at the target weights."""
    return mixing.mix_documents(docs.select(_row(docs), "doc_id", "text", "lang", "source")).select("whole_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Packs every document into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and packing have no form in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
