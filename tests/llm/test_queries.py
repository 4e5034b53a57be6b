"""Every registered query of the subpackage over the test tables, against SQL or brute force."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from notewright.llm import queries as Q
from tests.compare import MEDIUM, SMALL, assert_same, connect
from tests.llm import brute


@pytest.fixture(scope="module")
def texts():
    return {d: connect(d).execute("SELECT doc_id, text FROM documents").fetchall() for d in (SMALL, MEDIUM)}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("name", ["op5_source_mixing", "op6_ball_tree_search", "op8_imatch", "op12_filter_audit", "op13_drake_clusters"])
def test_native_and_search_equal_sql(spark, name):
    assert assert_same(Q.queries()[name](spark, MEDIUM), Q.oracle_sql()[name], MEDIUM) > 0


def test_language(spark):
    lang = dict(connect(MEDIUM).execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = Q.op1_language_id(spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in kept]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.05


def test_substring_dedup(spark, texts):
    got = [tuple(r) for r in Q.op2_substring_dedup(spark, MEDIUM).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = brute.substring_words(texts[MEDIUM])
    assert sum(r[2] for r in want) > 0 and sorted(got) == sorted(want)


def test_suffix_array_dedup(spark, texts):
    got = [tuple(r) for r in Q.op3_suffix_array_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    want = brute.substring_bytes(texts[SMALL])
    assert sum(r[2] for r in want) > 0 and sorted(got) == sorted(want)


def check_packing(rows, texts, sequence=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = t.encode_batch([x or "" for _, x in texts], add_special_tokens=False)
    ids = {d: np.array([*e.ids, 1], "<u4") for (d, _), e in zip(texts, encoded, strict=True)}
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == len(x)
    padded = 0
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence
        padded += 0 if at & (at - 1) == 0 else sequence - at
    assert padded <= 0.01 * sum(map(len, ids.values()))


def test_packing(spark, texts):
    check_packing(Q.op4_mixture_packing(spark, MEDIUM).collect(), texts[MEDIUM])


def test_packing_of_special_tokens(spark):
    """Ids are those of the tokenizer as its file describes it, added tokens included."""
    import public_tokenizers

    from notewright.llm import packing

    texts = ["hello <|endoftext|> world", "<|startoftext|>", "x<|endoftext|><|endoftext|>y É", "<|ENDOFTEXT|> <|endoftext|", "Ünï<|startoftext|>ñ", "<|\nendoftext|>", "don't 12 \x1c <|endoftext|>"] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string")
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    check_packing(got, rows)
    assert {r.doc_tokens for r in got if r.doc_id == 0} == {4}


def test_packing_keeps_the_mixture(spark):
    """While all sources last, each is within two grains of its share after any sequence; deficits are carried."""
    import public_tokenizers

    from notewright.llm import packing

    rows = Q.op4_mixture_packing(spark, MEDIUM).select("source", "length", "sequence_id").collect()
    got, ends, n = defaultdict(lambda: defaultdict(int)), defaultdict(int), len(Q.PACKING_WEIGHTS)
    for r in rows:
        got[r.sequence_id][r.source] += r.length
        ends[r.source] = max(ends[r.source], r.sequence_id)
    assert set(ends) == set(Q.PACKING_WEIGHTS)
    served, whole, short = defaultdict(int), min(ends.values()) - packing.PERIOD_SEQUENCES, 0
    assert whole > 20
    for s in range(whole):
        for source, k in got[s].items():
            served[source] += k
        assert sum(got[s].values()) == packing.SEQUENCE
        short += len(got[s]) < n  # a window holds 16 grains: the others are owed, and served in the next one
        assert all(abs(served[x] - (s + 1) * packing.SEQUENCE / n) <= 2 * packing.GRAIN for x in ends), s
    assert short > 0
    weighted = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("source IN ('src1', 'src2')")
    first = packing.pack(weighted, public_tokenizers.path("word_bpe_49k.json"), {"src1": 3, "src2": 1}).where("sequence_id < 8").groupBy("source").sum("length").collect()
    assert {r[0]: r[1] for r in first} == {"src1": 8 * 1536, "src2": 8 * 512}


def test_packing_many_sources(spark, monkeypatch):
    """Sources beyond the queues share one; every id still lies in one piece."""
    import public_tokenizers

    from notewright.llm import packing

    monkeypatch.setattr(packing, "MOST_QUEUES", 7)
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 60)), f"host{i % 400}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))
    check_packing(pieces.collect(), [(i, t) for i, t, _ in rows])
    assert pieces.select("source").distinct().count() == len({s for *_, s in rows})


def test_quality(spark):
    label = dict(connect(MEDIUM).execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = Q.op7_pu_quality(spark, MEDIUM).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in rows)
    kept = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in kept if y == 1], [s for s, y in kept if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([(s >= 0.7) == (y == 1) for s, y in kept]) > 0.85


def test_secrets(spark, texts):
    rows = Q.op9_secret_scan(spark, MEDIUM).collect()
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows]
    want = [brute.secrets_row(*x) for x in texts[MEDIUM]]
    assert sum(r[1] for r in want) > 0 and sorted(got) == sorted(want)
    for r in rows:  # base spans stay
        assert len([s for s in r.spans.split(",") if s]) == r.n_assign + r.n_access + r.n_hex + r.n_linked


def test_jaccard_components(spark, texts):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in Q.op10_parity_sketch_join(spark, MEDIUM).collect()]
    want = brute.jaccard_components(texts[MEDIUM])
    assert len({r[2] for r in want}) < len(want) and sorted(got) == sorted(want)


def test_ngram_perplexity(spark, texts):
    rows = Q.op11_ngram_perplexity(spark, MEDIUM).collect()
    want = {d: brute.quality_rules(t) for d, t in texts[MEDIUM]}
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == want and len(rows) == len(want)
    assert all(r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high) for r in rows)
    quality = dict(connect(MEDIUM).execute("SELECT doc_id, quality FROM labels").fetchall())
    passed = [r for r in rows if not r.base_failed]
    share = lambda q: np.mean([r.kept for r in passed if quality.get(r.doc_id) == q])
    assert share(1) > 0.93 and share(0) < share(1)
