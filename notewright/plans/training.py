"""Queries over training sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notewright.functions import prompts
from notewright.operators import tokens
from notewright.plans.tables import table

MARK = "says :"


def _sequences(spark, sf_dir):
    """Turns of conversations as token ids, the answer after a mark."""
    turns = table(spark, sf_dir, "conversations")
    said = F.concat("role", F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.lit(f" {MARK} ")), F.col("text"))
    return tokens.features(turns.select("conv_id", "turn", said.alias("said")), tokens.word_ids(F.col("said")), tokens.word_marks(MARK)).drop("said")


def label_mask(spark, sf_dir):
    return _sequences(spark, sf_dir)


def pad_batch(spark, sf_dir):
    """Labels padded within each conversation."""
    return tokens.pad_labels(_sequences(spark, sf_dir), "conv_id").select("conv_id", "turn", "labels")


def typed_sequences(spark, sf_dir):
    return tokens.typed(_sequences(spark, sf_dir))


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tokens.word_count(F.col("text")).alias("length"))


def length_filter(spark, sf_dir):
    return tokens.within_length(_lengths(spark, sf_dir), 512)


def length_filter_report(spark, sf_dir):
    return tokens.filter_report(_lengths(spark, sf_dir), 512).withColumn("percent_removed", F.round("percent_removed", 6))


def length_stats(spark, sf_dir):
    return tokens.length_stats(_lengths(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 6))


def chat_format(spark, sf_dir):
    """Each user turn and its answer in both chat templates."""
    following = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(following).alias("answer"), F.lead("role").over(following).alias("by"))
    pairs = turns.where("role = 'user' AND by = 'assistant'")
    shown = lambda name: F.md5(prompts.chat(name, F.col("text"), F.col("answer")).cast("binary"))
    return pairs.select("conv_id", "turn", shown("qwen").alias("im_md5"), shown("gemma").alias("turn_md5"))


def tokenize_documents(spark, sf_dir, tokenizer_path: str | None = None):
    """Ids of every text by a public tokenizer: how many, and a digest of them."""
    import public_tokenizers

    encode = tokens.batch_encoder(tokens.ranks_file(tokenizer_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    made = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", encode(F.col("text")).alias("ids"))
    return made.select("doc_id", F.size("ids").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"))


QUERIES = {f.__name__: f for f in (label_mask, pad_batch, typed_sequences, length_filter, length_filter_report, length_stats, chat_format, tokenize_documents)}

_IDS = lambda s: f"list_transform(list_filter(regexp_split_to_array({s}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), lambda w: (('0x' || substring(md5(w), 1, 8))::BIGINT % {tokens.VOCABULARY})::INT)"
_SEQUENCES = f"""a AS (SELECT conv_id, turn, {_IDS(f"(role || CASE role WHEN 'system' THEN ' ' ELSE ' {MARK} ' END || text)")} AS ids, {_IDS(f"'{MARK}'")} AS t FROM conversations),
b AS (SELECT *, len(ids) AS n, list_filter(range(1, len(ids) - 1), lambda i: ids[i] = t[1] AND ids[i + 1] = t[2])[1] AS mark FROM a),
s AS (SELECT conv_id, turn, ids AS input_ids, list_transform(ids, lambda x: 1::TINYINT) AS attention_mask, list_transform(ids, lambda x, i: (CASE WHEN i <= coalesce(mark + 1, 0) THEN -100 ELSE x END)::BIGINT) AS labels, n::INT AS length FROM b)"""
_LENGTHS = "l AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::INT AS length FROM documents)"
_CHAT = lambda name: (lambda u, a, c: f"md5('{u}' || text || '{c}{a}' || answer || '{c}')")(*prompts.TEMPLATES[prompts.family_of(name)])

ORACLES = {
    "label_mask": f"WITH {_SEQUENCES} SELECT * FROM s",
    "pad_batch": f"WITH {_SEQUENCES}, m AS (SELECT conv_id, max(length) AS longest FROM s GROUP BY conv_id) SELECT conv_id, turn, list_resize(labels, longest, -100::BIGINT) AS labels FROM s JOIN m USING (conv_id)",
    "typed_sequences": f"WITH {_SEQUENCES} SELECT input_ids, attention_mask, labels FROM s",
    "length_filter": f"WITH {_LENGTHS} SELECT * FROM l WHERE length <= 512",
    "length_filter_report": f"WITH {_LENGTHS} SELECT count(*) AS n_rows, count_if(length > 512)::BIGINT AS n_removed, round(100.0 * count_if(length > 512) / count(*), 6) AS percent_removed FROM l",
    "length_stats": f"WITH {_LENGTHS} SELECT min(length) AS min_length, max(length) AS max_length, round(avg(length), 6) AS mean_length, list_sort(list(length))[count(*) // 2 + 1] AS median_length FROM l",
    "chat_format": f"""SELECT conv_id, turn, {_CHAT('qwen')} AS im_md5, {_CHAT('gemma')} AS turn_md5 FROM (
  SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
}
