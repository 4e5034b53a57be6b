"""Every registered query against its SQL, over the same tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notewright.operators import tokens
from notewright.plans import registry
from tests.compare import MEDIUM, SMALL, assert_same, connect


#: A tokenizer's ids have no SQL.
NO_SQL = {"tokenize_documents"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - NO_SQL))
def test_query_equals_sql(spark, name):
    n = assert_same(registry.queries()[name](spark, MEDIUM), registry.oracle_sql()[name], MEDIUM)
    assert n > 0 or name == "group_split_overlap"


def test_each_has_sql():
    assert set(registry.queries()) - NO_SQL == set(registry.oracle_sql())


def test_bucketed_sides_meet_without_a_shuffle(spark):
    df = registry.queries()["recall_bucketed"](spark, MEDIUM)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    same = registry.queries()["recall_merged"](spark, MEDIUM)
    assert df.exceptAll(same).isEmpty() and same.exceptAll(df).isEmpty()


def test_ids_of_documents_are_the_tokenizer_s(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc_id, text in connect(SMALL).execute("SELECT doc_id, text FROM documents").fetchall():
        ids = made.encode(text, add_special_tokens=False).ids
        want[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in registry.queries()["tokenize_documents"](spark, SMALL).collect()} == want
    other = tokens.batch_encoder(tokens.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert {r.doc_id: r.n for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.size(other("text")).alias("n")).collect()} == {k: n for k, (n, _) in want.items()}
