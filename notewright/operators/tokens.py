"""Training sequences: token ids, masked labels, length filter and statistics, padding.

A tokenizer is a function made once a worker: text -> list of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from notewright.functions.prompts import chat, response_template
from notewright.functions.text import let

#: Fixed value: the label that a loss leaves out.
MASKED = -100
VOCABULARY = 50_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_ids(text: Column, vocabulary: int = VOCABULARY) -> Column:
    """Ids of a built-in tokenizer: white-space words, hashed. For tests and where no model is at hand."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % vocabulary).cast("int"))


def word_marks(text: str, vocabulary: int = VOCABULARY) -> list[int]:
    """word_ids() of a fixed text, for a template."""
    return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % vocabulary for w in text.split()]


def word_count(text: Column) -> Column:
    """How many ids word_ids() gives; nothing is hashed."""
    return F.size(words(text))


#: Characters of text that an encoder is given at once.
BATCH_CHARS = 1 << 18


def batch_encoder(make: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]):
    """Arrow function text -> array<int> by the batch tokenizer that make() gives: many texts a call, ids straight into list arrays."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        for column in columns:
            texts = column.to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            sizes, parts, at = np.zeros(len(texts), np.int64), [], 0
            while at < len(known):
                stop, chars = at, 0
                while stop < len(known) and (stop == at or chars + len(texts[known[stop]]) <= BATCH_CHARS):
                    chars += len(texts[known[stop]])
                    stop += 1
                for i, ids in zip(known[at:stop], encode([texts[i] for i in known[at:stop]]), strict=True):
                    sizes[i] = len(ids)
                    parts.append(np.asarray(ids, np.int32))
                at = stop
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            missing = pa.array([t is None for t in texts], pa.bool_())
            yield pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)

    return F.arrow_udf(run, "array<int>", ArrowUDFType.SCALAR_ITER)


def encoder(make: Callable[[], Callable[[str], Sequence[int]]]):
    """batch_encoder() of a tokenizer that takes one text."""

    def batch():
        encode = make()
        return lambda texts: [encode(t) for t in texts]

    return batch_encoder(batch)


def tokenizer_file(path: str) -> Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]:
    """For batch_encoder(): a tokenizer's JSON file, without special tokens; every worker reads it once."""

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]

    return make


def ranks_file(path: str, pattern: str) -> Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]:
    """For batch_encoder(): a byte-pair vocabulary of lines `base64 rank`, texts cut by a pattern first. Some five times as fast as a JSON file of the same vocabulary."""

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        made = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: made.encode_ordinary_batch(texts, num_threads=1)

    return make


def mask_labels(ids: Column, template: Sequence[int]) -> Column:
    """ids as labels, all up to the end of the first template within them masked.

    A template that ends the sequence is not looked for, and without one nothing is masked. One
    pass finds it: positions are compared with the template mark by mark, most with its first alone.
    """
    k = len(template)

    def masked(xs: Column) -> Column:
        starts = F.when(F.size(xs) > k, F.sequence(F.lit(0), F.size(xs) - k - 1)).otherwise(F.array().cast("array<int>"))

        def begins(i: Column) -> Column:
            found = F.lit(True)
            for j, mark in enumerate(template):
                found = found & (F.get(xs, i + j) == mark)
            return found

        at = F.try_element_at(F.filter(starts, begins), F.lit(1))
        return let(F.coalesce(at + k, F.lit(0)), lambda until: F.transform(xs, lambda x, i: F.when(i < until, F.lit(MASKED)).otherwise(x).cast("bigint")))

    return let(ids, masked)


def features(df: DataFrame, ids: Column, template: Sequence[int]) -> DataFrame:
    """(input_ids, attention_mask, labels, length) beside the columns of df; ids are made once a row."""
    one = lambda xs: F.struct(xs.alias("input_ids"), F.transform(xs, lambda _: F.lit(1).cast("tinyint")).alias("attention_mask"), mask_labels(xs, template).alias("labels"), F.size(xs).alias("length"))
    made = df.withColumn("_made", let(ids, one))
    return made.select(*df.columns, *[F.col("_made")[c].alias(c) for c in ("input_ids", "attention_mask", "labels", "length")])


def training_features(df: DataFrame, model_name: str, make: Callable[[], Callable[[str], Sequence[int]]], source: str = "input", target: str = "output") -> DataFrame:
    """features() of pairs rendered by the model's chat template; the pairs themselves go."""
    marks = [int(x) for x in make()(response_template(model_name))]
    rendered = df.select(encoder(make)(chat(model_name, F.col(source), F.col(target))).alias("_ids"))
    return features(rendered, F.col("_ids"), marks).drop("_ids")


def within_length(df: DataFrame, most: int = 16384) -> DataFrame:
    return df.where(F.col("length") <= most)


def filter_report(df: DataFrame, most: int = 16384) -> DataFrame:
    """One row: sequences, how many are too long, and their percentage (null without any sequence)."""
    gone = F.count_if(F.col("length") > most)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), gone.alias("n_removed"), F.try_divide(100.0 * gone, F.count(F.lit(1))).alias("percent_removed"))


def length_stats(df: DataFrame) -> DataFrame:
    """One row: least, greatest and mean length, and the upper median.

    Found from counts by length, of which there are no more than a sequence may be long.
    """
    counts = df.where(F.col("length").isNotNull()).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.select("length", "n", F.sum("n").over(Window.orderBy("length")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("length")))
    return ordered.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_length"), middle.alias("median_length"))


def pad_labels(df: DataFrame, batch: str, labels: str = "labels") -> DataFrame:
    """df with labels padded on the right, masked, to the longest of their batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(labels)).alias("_longest"))
    return df.join(longest, batch).withColumn(labels, F.concat(labels, F.array_repeat(F.lit(MASKED).cast("bigint"), F.col("_longest") - F.size(labels)))).drop("_longest")


def typed(df: DataFrame) -> DataFrame:
    """The three feature columns in the types that training reads."""
    return df.select(F.col("input_ids").cast("array<int>"), F.col("attention_mask").cast("array<tinyint>"), F.col("labels").cast("array<bigint>"))
