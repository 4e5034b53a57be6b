"""Rules, the Kneser-Ney model against its definition, the two ways to look n-grams up, and bands."""

from __future__ import annotations

import math
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from notewright.llm import perplexity
from tests.llm import brute
from tests.llm.test_edges import CLASHING, odd_rows, prose
from tests.llm.test_edges import clashing, empty, odd  # noqa: F401

NEW = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "low", "high", "kept"}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "a a a a", "x\nx\n \n\nx y\nx", "#*$ %&| <> é\xa0é　z", "a b a b a", "w " * 60, "\x1c\x85 q"])
def test_rules_of_small_texts(text):
    assert perplexity.measure(text) == brute.quality_rules(text)


def test_rules_of_long_texts():
    for text in (prose(4, 3000), " ".join(prose(i % 7, 40) for i in range(50)), "\n".join(prose(i % 5, 6) for i in range(40))):
        assert perplexity.measure(text) == brute.quality_rules(text)


@pytest.mark.parametrize("most_entries", [perplexity.BROADCAST_ENTRIES, 0])
def test_scores_equal_the_definition(spark, most_entries):
    """Each fold by the model of the other, arrays in every task or looked up block by block."""
    texts = [(i, prose(i % 9, 20 + i) if i % 4 else "é€ß 🎉 " + prose(3, 15), ["en", "de", None][i % 3]) for i in range(60)] + [(60, None, "en"), (61, "", "xx"), (62, prose(1, 21), "en"), (62, prose(1, 21), "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    fold = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2))).collect()}
    found = rows_of(perplexity.filter_quality(docs, order=3, most_entries=most_entries))
    assert len(found) == len(texts)
    sequences = defaultdict(list)
    for _, t, lang in texts:
        sequences[lang or "", fold[t or ""]].append((t or "").encode())
    models = {k: brute.KneserNey(v, 3) for k, v in sequences.items()}
    plain = {i: (t or "", lang or "") for i, t, lang in texts}
    for r in found:
        text, lang = plain[r["doc_id"]]
        model = models.get((lang, 1 - fold[text]))
        want = model.log_ppl(text.encode()) if model else math.log(257)
        assert abs(r["log_ppl"] - want) < 1e-9, (text, r["log_ppl"], want)


def test_bands_are_medians_of_distinct_texts(spark):
    scored = [("a", "en", True, False, 1.0), ("b", "en", True, False, 1.1), ("b", "en", True, False, 1.1), ("c", "en", True, False, 1.4), ("d", "en", True, True, 9.0), ("e", "", False, False, 2.0), ("f", "de", True, True, 3.0)]
    df = spark.createDataFrame(scored, "k string, lm_lang string, lm_known boolean, base_failed boolean, log_ppl double")
    got = {r.lm_lang: (round(r.low, 6), round(r.high, 6)) for r in perplexity.bands(df, "k", 2, 3, 0.01).collect()}
    middle = statistics.median_low([1.0, 1.1, 1.4])
    spread = statistics.median_low([abs(x - middle) for x in (1.0, 1.1, 1.4)])
    assert got == {"en": (round(middle - 2 * spread, 6), round(middle + 3 * spread, 6)), "": (1.98, 2.03)}


def test_odd_rows(clashing, empty):  # noqa: F811
    found = rows_of(perplexity.filter_quality(clashing))
    assert len(found) == len(odd_rows()) and set(found[0]) == {"doc_id", "lang", "source", "n_chars", *CLASHING} | NEW
    want = sorted((str(i), str(lang), brute.quality_rules(t)) for i, t, lang, _, _ in odd_rows())
    assert sorted((str(r["doc_id"]), str(r["lang"]), tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert perplexity.filter_quality(empty).isEmpty()


def test_an_outlier_is_rejected_and_copies_do_not_move_the_band(spark):
    texts = [prose(i, 80) for i in range(60)] + [prose(0, 80)] * 200
    odd_one = " ".join(chr(0x3041 + (i * 7919) % 80) * 3 for i in range(90))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, odd_one])], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in perplexity.filter_quality(docs).select("doc_id", "kept").collect()}
    assert not kept[len(texts)] and sum(kept.values()) >= len(texts) - 3 and kept[0] and kept[100]
