"""Quality rules over words and lines, and perplexity bands of an n-gram model for each language.

The model is a modified Kneser-Ney model over the bytes of UTF-8, of order ORDER. An n-gram's hash is
its bytes packed into a long, so no two meet; Spark counts n-grams over all texts, derives the
continuation counts of each lower order, discounts and interpolated probabilities order by order,
and stores them as a table that scoring turns into sorted arrays of hashes.

No text is scored by counts of its own: texts are dealt to two folds by their hash (copies to the
same one) and each fold is scored by the model of the other. Where the arrays of all models together are
small (checked), every task gets them; otherwise the n-grams that a block of texts holds are
looked up by a join and come back to the block. Both ways give the same numbers.

A language's band is its median log-perplexity per byte, less or more a multiple of the median
deviation from it, over all distinct texts that pass the rules. A text outside its band is rejected.

Defined results: a null text counts as empty and fails the rules; a null language is one of its
own; a text whose language the other fold lacks is scored by a uniform model; repeated rows and
equal texts of a language get equal answers; a language none of whose texts pass the rules has no
band and rejects no more; an empty table gives an empty one; columns named like new ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.arrowtext import groups, text_bytes
from notewright.llm.common import append_arrow, shared_table, shuffle_parts

ORDER = 5
#: Bytes that no UTF-8 text holds: before the first byte of a text, and after its last.
START, END = 0xFF, 0xFE
#: What a model without counts gives each byte, and the end.
UNIFORM = -math.log(257)
#: Discounts of n-grams seen once, twice and more often, where counts are too few to estimate them.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)
#: The rules: fewest words, and the largest percentage of words in repeated windows of three.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The band: so many median deviations below and above the median, each deviation of this size at least.
BELOW, ABOVE, LEAST_SPREAD = 8.0, 8.0, 0.01
#: Steps in which log-perplexity is counted for medians.
STEP = 1e-4
#: Rows of a batch taken at once, n-grams a counting task holds before it hands them on, entries of all models that every task may get, bytes of text in a block.
SLICE_ROWS, HELD_GRAMS, BROADCAST_ENTRIES, BLOCK_BYTES = 512, 3 << 19, 6_000_000, 8 << 20
#: Models and orders up to which their discounts are broadcast, and languages for their bands; beyond, Spark chooses the join.
BROADCAST_DISCOUNTS = BROADCAST_LANGUAGES = 100_000

RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


# --- rules ---------------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    _, place, seen = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(seen[place] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The columns RULES of one text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at these six separators and no others
    spaces, symbols = (len(raw) - len(raw.translate(None, marks)) for marks in (_SPACE, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    return len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated, failed


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns RULES."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.bool_()]
        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield batch, [pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [()] * 6, kinds, strict=True)]

    return append_arrow(docs, run, RULES)


# --- counting ------------------------------------------------------------------------------------


def byte_grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Of the texts in turn, the n-gram that ends at each byte and at the end, packed: one more than bytes each."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(raw) + n * order, START, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * order - 1, sizes)] = raw
    padded[offsets[1:] + np.arange(1, n + 1) * order - 1] = END
    keys = np.zeros(max(0, len(padded) - order + 1), np.int64)
    for i in range(order):
        keys = (keys << 8) | padded[i : i + len(keys)]
    return keys[padded[order - 1 :] != START]


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def _models(batch, text: str) -> list[tuple[tuple[str, int], np.ndarray]]:
    """The rows of a batch by (language, fold)."""
    langs, folds = batch.column(batch.schema.get_field_index("lm_lang")).to_pylist(), batch.column(batch.schema.get_field_index("lm_fold")).to_pylist()
    rows: dict[tuple[str, int], list[int]] = {}
    for i, k in enumerate(zip(langs, folds, strict=True)):
        rows.setdefault(k, []).append(i)
    return [(k, np.array(v)) for k, v in rows.items()]


def _texts(batch, text: str, rows: np.ndarray):
    """(places of rows, bytes, offsets) in groups of bounded size."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).take(pa.array(rows))
    data, offsets = text_bytes(column)
    for i, j in groups(offsets):
        yield rows[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)


def _keyed(docs: DataFrame, text: str, lang: Column) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"lm_lang": F.coalesce(lang.cast("string"), F.lit("")), "lm_known": lang.isNotNull(), "lm_fold": F.pmod(F.xxhash64(whole), F.lit(2)).cast("int")})


def count(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(lm_lang, lm_fold, gram, n) over all texts, reduced before the shuffle."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[str, int], list] = {}
        size = 0

        def out():
            for (lang, fold), found in held.items():
                keys, counts = _merged(found)
                for i in range(0, len(keys), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    m = len(keys[part])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([fold] * m, pa.int32()), pa.array(keys[part]), pa.array(counts[part])], names=["lm_lang", "lm_fold", "gram", "n"])

        for batch in _slices(batches):
            for k, rows in _models(batch, text):
                for _, raw, offsets in _texts(batch, text, rows):
                    found = np.unique(byte_grams(raw, offsets, order), return_counts=True)
                    held.setdefault(k, []).append(found)
                    size += len(found[0])
            if size > HELD_GRAMS:
                held = {k: [_merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD_GRAMS // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return docs.select("lm_lang", "lm_fold", text).mapInArrow(run, "lm_lang string, lm_fold int, gram long, n long").groupBy("lm_lang", "lm_fold", "gram").agg(F.sum("n").alias("n"))


# --- model ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PerplexityModel:
    """table: (lm_lang, lm_fold, n, gram, value). n from 1 on: log-probability of the last of n bytes after the
    others; n below: log of what is left for shorter contexts after the first -n - 1 bytes."""

    table: DataFrame
    order: int


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _discounts(counts: DataFrame) -> DataFrame:
    """D1, D2, D3 of each (language, fold, order) from how many n-grams are seen once to four times."""
    model = ["lm_lang", "lm_fold", "order"]
    seen = counts.groupBy(*model).agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fitted = [F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}") for i in (1, 2, 3)]
    enough = F.least("n1", "n2", "n3", "n4") > 0
    sound = enough
    for i, d in enumerate(fitted, 1):
        sound = sound & (F.when(enough, d) > 0) & (F.when(enough, d) < i)
    return seen.select(*model, *[F.when(sound, d).otherwise(F.lit(p)).alias(f"d{i}") for i, (d, p) in enumerate(zip(fitted, PLAIN_DISCOUNTS, strict=True), 1)])


def fit(docs: DataFrame, text: str, order: int) -> PerplexityModel:
    """The models of every (lm_lang, lm_fold) of docs."""
    model = ["lm_lang", "lm_fold"]
    levels = {order: shared_table(count(docs, text, order), "grams")}
    for n in range(order - 1, 0, -1):  # a shorter n-gram counts the bytes that come before it
        shorter = F.col("gram").bitwiseAND(F.lit(_mask(n)))
        levels[n] = shared_table(levels[n + 1].groupBy(*model, shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    every = levels[1].withColumn("order", F.lit(1))
    for n in range(2, order + 1):
        every = every.unionByName(levels[n].withColumn("order", F.lit(n)))
    discounts = shared_table(_discounts(every), "discounts")
    if discounts.count() <= BROADCAST_DISCOUNTS:
        discounts = F.broadcast(discounts)
    parts, shorter = [], None
    for n in range(1, order + 1):
        seen = levels[n].join(discounts.where(F.col("order") == n), model).select(*model, "gram", F.shiftright("gram", 8).alias("context"), "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"), "d1", "d2", "d3")
        several = F.count(F.when(F.col("n") > 2, 1))
        left = F.first("d1") * F.count(F.when(F.col("n") == 1, 1)) + F.first("d2") * F.count(F.when(F.col("n") == 2, 1)) + F.first("d3") * several
        contexts = shared_table(seen.groupBy(*model, "context").agg(F.sum("n").alias("total"), (left / F.sum("n")).alias("rest")), "contexts")
        own = seen.join(contexts, [*model, "context"]).select(*model, "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), "rest", F.col("gram").bitwiseAND(F.lit(_mask(n - 1))).alias("shorter"))
        if shorter is None:
            found = own.select(*model, "gram", (F.col("own") + F.col("rest") * math.exp(UNIFORM)).alias("p"))
        else:
            found = own.join(shorter.select(*model, F.col("gram").alias("shorter"), F.col("p").alias("below")), [*model, "shorter"]).select(*model, "gram", (F.col("own") + F.col("rest") * F.col("below")).alias("p"))
        shorter = shared_table(found, "probabilities")
        parts.append(shorter.select(*model, F.lit(n).alias("n"), "gram", F.log("p").alias("value")))
        parts.append(contexts.select(*model, F.lit(-n).alias("n"), F.col("context").alias("gram"), F.log("rest").alias("value")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return PerplexityModel(table, order)


# --- scoring -------------------------------------------------------------------------------------

Arrays = dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]]


def sorted_arrays(table) -> Arrays:
    """For each (language, fold, n) of an Arrow table: n-grams in ascending order and their values."""
    import pyarrow.compute as pc

    found: Arrays = {}
    if not table.num_rows:
        return found
    names = table.group_by(["lm_lang", "lm_fold", "n"]).aggregate([]).to_pylist()
    for k in names:
        rows = table.filter((pc.field("lm_lang") == k["lm_lang"]) & (pc.field("lm_fold") == k["lm_fold"]) & (pc.field("n") == k["n"]))
        keys = rows.column("gram").to_numpy()
        order = np.argsort(keys)
        found[k["lm_lang"], k["lm_fold"], k["n"]] = keys[order], rows.column("value").to_numpy()[order]
    return found


def _looked_up(arrays: Arrays, key: tuple[str, int, int], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of each n-gram."""
    if key not in arrays:
        return np.zeros(len(grams), bool), np.zeros(len(grams))
    keys, values = arrays[key]
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return keys[at] == grams, values[at]


def log_probabilities(arrays: Arrays, lang: str, fold: int, grams: np.ndarray, order: int) -> np.ndarray:
    """Of each n-gram the log-probability of its last byte, from the longest end of it that is known."""
    out, open_ = np.zeros(len(grams)), np.arange(len(grams))
    for n in range(order, 0, -1):
        found, value = _looked_up(arrays, (lang, fold, n), grams[open_] & _mask(n))
        out[open_[found]] += value[found]
        open_ = open_[~found]
        if not len(open_):
            return out
        known, value = _looked_up(arrays, (lang, fold, -n), (grams[open_] >> 8) & _mask(n - 1))
        out[open_[known]] += value[known]
    out[open_] += UNIFORM
    return out


def _scores(batch, text: str, arrays: Arrays, order: int) -> np.ndarray:
    """Log-perplexity per byte of each text of a batch, by the model of the other fold."""
    import pandas as pd

    out = np.zeros(batch.num_rows)
    for (lang, fold), rows in _models(batch, text):
        for at, raw, offsets in _texts(batch, text, rows):
            place, grams = pd.factorize(byte_grams(raw, offsets, order))
            sizes = np.diff(offsets) + 1
            of = np.repeat(np.arange(len(at)), sizes)
            out[at] = -np.bincount(of, weights=log_probabilities(arrays, lang, 1 - fold, grams, order)[place], minlength=len(at)) / sizes
    return out


def _needed(batch, text: str, order: int):
    """((language, fold of the model, n), distinct n-grams) that scoring a block may ask for."""
    for (lang, fold), rows in _models(batch, text):
        grams = np.unique(np.concatenate([np.unique(byte_grams(raw, offsets, order)) for _, raw, offsets in _texts(batch, text, rows)]))
        for n in range(order, 0, -1):
            yield (lang, 1 - fold, n), np.unique(grams & _mask(n))
            yield (lang, 1 - fold, -n), np.unique((grams >> 8) & _mask(n - 1))


def log_perplexity(docs: DataFrame, model: PerplexityModel, text: str, most_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """docs (with lm_lang and lm_fold) and `log_ppl`."""
    import pyarrow as pa

    spark, order = docs.sparkSession, model.order
    if model.table.limit(most_entries + 1).count() <= most_entries:
        shared = spark.sparkContext.broadcast(sorted_arrays(model.table.toArrow()))

        def run(batches):
            for batch in batches:
                scores = [_scores(part, text, shared.value, order) for part in _slices([batch])]
                yield batch, [pa.array(np.concatenate(scores) if scores else [], pa.float64())]

        return append_arrow(docs, run, "log_ppl double")

    from pyspark.sql import types as T

    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(shuffle_parts(spark), size // BLOCK_BYTES)
    names = [c for c in docs.columns if c != "log_ppl"]
    blocked = docs.select(*names, F.pmod(F.xxhash64(*names), F.lit(blocks)).alias("lm_block")).repartition(blocks, "lm_block")
    model_key = ["lm_lang", "lm_fold", "n", "gram"]

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("lm_block")[0].as_py()
        parts = [pa.table({"lm_block": pa.array([block] * len(g), pa.int64()), "lm_lang": pa.array([k[0]] * len(g)), "lm_fold": pa.array([k[1]] * len(g), pa.int32()), "n": pa.array([k[2]] * len(g), pa.int32()), "gram": pa.array(g)}) for k, g in _needed(table.combine_chunks().to_batches()[0], text, order)]
        return pa.concat_tables(parts)

    asked = blocked.groupBy("lm_block").applyInArrow(ask, "lm_block long, lm_lang string, lm_fold int, n int, gram long")
    told = asked.join(model.table, model_key).select("lm_block", *model_key, "value")

    def answer(texts: pa.Table, values: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return texts.drop_columns(["lm_block"]).append_column("log_ppl", pa.array([], pa.float64()))
        batch = texts.combine_chunks().to_batches()[0]
        return texts.drop_columns(["lm_block"]).append_column("log_ppl", pa.array(_scores(batch, text, sorted_arrays(values), order), pa.float64()))

    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("log_ppl", T.DoubleType())])
    return blocked.groupBy("lm_block").cogroup(told.groupBy("lm_block")).applyInArrow(answer, schema)


# --- bands ---------------------------------------------------------------------------------------


def _medians(counted: DataFrame, value: str) -> DataFrame:
    """(lm_lang, lm_known, median) of a table of values and counts: the lower one of two in the middle."""
    from pyspark.sql import Window

    w = Window.partitionBy("lm_lang", "lm_known").orderBy(value)
    upto = counted.withColumns({"upto": F.sum("n").over(w), "of": F.sum("n").over(Window.partitionBy("lm_lang", "lm_known"))})
    return upto.where(2 * F.col("upto") >= F.col("of")).groupBy("lm_lang", "lm_known").agg(F.min(value).alias("median"))


def bands(scored: DataFrame, text_key: str, below: float = BELOW, above: float = ABOVE, least_spread: float = LEAST_SPREAD) -> DataFrame:
    """(lm_lang, lm_known, low, high): bounds of log-perplexity, from distinct texts that pass the rules."""
    lang = ["lm_lang", "lm_known"]
    step = F.round(F.col("log_ppl") / STEP).cast("long")
    distinct = scored.where(~F.col("base_failed")).groupBy(*lang, text_key).agg(F.min(step).alias("step"))
    # written, so that counts are added up by step before all steps of a language meet
    counted = shared_table(distinct.groupBy(*lang, "step").agg(F.count(F.lit(1)).alias("n")), "steps")
    middle = _medians(counted, "step")
    off = counted.join(middle, lang).groupBy(*lang, F.abs(F.col("step") - F.col("median")).alias("off")).agg(F.sum("n").alias("n"))
    spread = _medians(off, "off").withColumnRenamed("median", "spread")
    wide = F.greatest(F.col("spread") * STEP, F.lit(least_spread))
    return middle.join(spread, lang).select(*lang, (F.col("median") * STEP - below * wide).alias("low"), (F.col("median") * STEP + above * wide).alias("high"))


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, most_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """docs without the text, with the columns RULES, log_ppl, low, high and kept."""
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "low", "high", "kept", "lm_key", "lm_lang", "lm_known", "lm_fold", "lm_block"}
    plain = docs.select(*[c for c in docs.columns if c.lower() not in new])
    keyed = _keyed(plain, text, F.col(lang))
    model = fit(keyed, text, order)
    scored = log_perplexity(with_rules(keyed, text), model, text, most_entries)
    scored = shared_table(scored.withColumn("lm_key", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).drop(text), "scored")
    limits = shared_table(bands(scored, "lm_key"), "bands")  # a row a language, so that no language gathers its documents
    if limits.count() <= BROADCAST_LANGUAGES:
        limits = F.broadcast(limits)
    judged = scored.join(limits, ["lm_lang", "lm_known"], "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("lm_lang", "lm_known", "lm_fold", "lm_key")
