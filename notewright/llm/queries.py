"""The registered query of each operator, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import balltree, drake_kmeans, filter_audit, imatch, language_id, mixing, packing, parity_join, perplexity, pu_quality, secret_scan, substring_dedup, suffix_dedup
from notewright.llm.common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the three training folds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once 35-word repeats are gone."""
    found = substring_dedup.repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document once 50-byte repeats of smaller doc_ids are gone."""
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The target mixture of op4: equal shares of these sources, while they last; any other comes after them.
PACKING_WEIGHTS = {f"src{i}": 1 for i in range(20)}


def op4_mixture_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents in sequences of 2048 tokens, each filled towards the target mixture."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return packing.pack(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), PACKING_WEIGHTS)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that fill a budget of all tokens at the example weights."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.mix_documents(docs).select("doc_id", F.expr(mixing.DOMAIN_SQL).alias("domain"), "lang", "source", "n_tokens", "epoch")


def op6_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 5 nearest by integer inner product of every 50th vector."""
    return balltree.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of the three training folds."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    train = lambda df: df.where(~held_out(F.col("doc_id")))
    model = pu_quality.fit(train(docs), train(labels))
    return pu_quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base kinds and linked weak parts."""
    found = secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in secret_scan.BASE],
        F.sha2(secret_scan.digest(F.col("base")), 256).alias("base_sha256"),
        secret_scan.digest(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def op10_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a 5-word shingle similarity of 0.8 or more."""
    return parity_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and perplexity bands over every document."""
    found = perplexity.filter_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps and removes, by language."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return filter_audit.audit(docs, filter_audit.corpus_filters(F.col("text")), F.col("lang"), {"good": labels.where("quality = 1"), "toxic": labels.where("toxic = 1")})


def op13_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in one of 40 clusters after five rounds."""
    return drake_kmeans.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries():
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_suffix_array_dedup, op4_mixture_packing, op5_source_mixing, op6_ball_tree_search, op7_pu_quality, op8_imatch, op9_secret_scan, op10_parity_sketch_join, op11_ngram_perplexity, op12_filter_audit, op13_drake_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": mixing.oracle(), "op6_ball_tree_search": balltree.oracle(), "op8_imatch": imatch.oracle(), "op12_filter_audit": filter_audit.oracle(), "op13_drake_clusters": drake_kmeans.oracle()}
