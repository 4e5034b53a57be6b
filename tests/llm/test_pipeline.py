"""The pipeline, stage by stage over what the stage before it kept, against plain versions of each."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from notewright.llm import language_id, mixing, packing, secret_scan
from tests.compare import MEDIUM, bag, connect
from tests.llm import brute
from tests.llm.test_queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage writes, as [(name, folder)], first the documents themselves."""
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = [("documents", f"{MEDIUM}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MEDIUM).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        found.append((name, str(root / name)))
    return found


def rows(spark, kept, i):
    return spark.read.parquet(kept[i][1]).collect()


def test_language_keeps_clear_documents(spark, kept):
    before, after = rows(spark, kept, 0), rows(spark, kept, 1)
    assert after[0].asDict().keys() == before[0].asDict().keys()
    assert set(after) <= set(before) and len(after) > 0.9 * len(before)
    assert any(held_out(r.doc_id) for r in after)


def test_near_duplicates(spark, kept):
    before, after = rows(spark, kept, 1), rows(spark, kept, 2)
    want = {c for _, _, c in brute.jaccard_components([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before) and set(after) <= set(before)


def all_spans(text):
    base = brute.base_spans(text)
    weak = [(m.start(), len(secret_scan.BASE) + k, m.end()) for k, p in enumerate(secret_scan.WEAK.values()) for m in re.finditer(p, text, re.ASCII)]
    part = lambda s: secret_scan.PART[secret_scan.KINDS[s[1]]]
    near = lambda a, b: b[0] - a[2] <= secret_scan.SCOPE and a[0] - b[2] <= secret_scan.SCOPE
    shown = [w for w in weak if all(w[2] <= b[0] or b[2] <= w[0] for b in base)]
    linked = [w for w in shown if len({part(o) for o in base + weak if near(w, o)} | {part(w)}) == 3]
    return sorted(base + linked)


def redacted(text):
    out, at = [], 0
    for start, kind, end in all_spans(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{secret_scan.KINDS[kind]}>"]
        at = end
    return "".join(out) + text[at:]


def test_secrets(spark, kept):
    before, after = rows(spark, kept, 2), rows(spark, kept, 3)
    want = Counter((r.doc_id, redacted(r.text), r.lang, r.source) for r in before)
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after) and any(redacted(r.text) != r.text for r in before)


def test_mixing(spark, kept):
    c = connect(MEDIUM)
    c.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{kept[3][1]}/*.parquet')")
    want = c.execute(f"SELECT doc_id, lang, source, n_tokens FROM ({mixing.oracle()})")
    got = [(r.doc_id, r.lang, r.source, len(brute.WORD.findall(r.text))) for r in rows(spark, kept, 4)]
    assert bag(got, COLUMNS[:1] + ["lang", "source", "x"]) == bag(want.fetchall(), COLUMNS[:1] + ["lang", "source", "x"])


def test_packing(spark, kept):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, pieces = rows(spark, kept, 4), rows(spark, kept, 5)
    times, spans = Counter(r.doc_id for r in docs), defaultdict(list)
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in docs}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        spans[p.doc_id].append(p.length)
    assert {d: sum(x) for d, x in spans.items()} == {d: len(ids[d]) * n for d, n in times.items()}


def test_run(spark, kept):
    out = corpus_pipeline.run(spark, MEDIUM)
    assert Counter(out.collect()) == Counter(rows(spark, kept, 5))


def test_language_tasks_give_back_what_packing_left(monkeypatch):
    caught, calls = [], []
    monkeypatch.setattr(language_id, "append_arrow", lambda df, fn, fields: caught.append(fn))
    monkeypatch.setattr(language_id, "forget", lambda: calls.append(1))
    language_id.predict(None, language_id.LanguageModel({}))
    assert list(caught[0]([])) == [] and calls == [1]


def test_packing_gives_back_its_tokenizers(spark, tmp_path, monkeypatch):
    import public_tokenizers

    mark = tmp_path / "given back"
    monkeypatch.setattr(packing, "forget", lambda: mark.touch())
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect() and mark.exists()
