"""Goldens of the scalar functions; expected values are written by hand."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright.functions import budgets, ids, jsontext, prompts, text, values


def column(spark, xs, kind, use):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_text(spark):
    assert column(spark, [" HTN\n", "  ", None, " A ", "\x1fB\t"], "string", text.normalize_text) == ["htn", None, None, "a", "b"]


def test_normalize_value(spark):
    given_ = ["1", "1.0", "1.00", "1.5", "1.50", " Pos ", "", "nan", "1_000", "5d", "inf", "1e-10", None, "-0", "-0.50", "+7", "007", "5.", ".5", "1E3", "-inf", "+NaN", "٣", "12345678901234567890", "0.0001", "1.2345678901", "5 MG", "infinity"]
    want = ["1", "1", "1", "1.5", "1.5", "pos", None, None, "1000", "5d", "inf", "1e-1", None, "0", "-0.5", "7", "7", "5", "0.5", "1000", "-inf", None, "3", "12345678901234567168", "0.0001", "1.2345678901", "5 mg", "inf"]
    assert column(spark, given_, "string", values.normalize_value) == want


def test_normalize_number(spark):
    assert column(spark, [1.0, 1.5, None, float("nan"), float("inf"), -0.0, 1e20, 1.5e-7], "double", values.normalize_number) == ["1", "1.5", None, None, "inf", "0", "1" + "0" * 20, "1.5e-07"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"\A[+-]?[0-9]{1,16}(\.[0-9]{0,5})?([eE][0-9]{1,2})?\Z") | st.text(max_size=6), min_size=50, max_size=50))
def test_native_values_equal_python(spark, xs):
    xs = [x for x in xs if "\x00" not in x and not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    assert column(spark, xs, "string", values.normalize_value) == [values.value_text(x) for x in xs]


def test_clean(spark):
    assert column(spark, ["NaN", " none ", "", "0", None, "banana"], "string", text.clean) == [None, None, None, "0", None, "banana"]
    assert column(spark, ["nan", "banana", None, "1.5"], "string", text.blank_missing) == ["", "banana", "", "1.5"]


def test_note_day(spark):
    rows = spark.createDataFrame([("2024-01-31T10:00:00", 1), ("bad", 1), ("2024", 0), (None, 0), ("2024-02-28", 2), ("2024-01-01T23:00:00+05:00", 0), ("2024-01-01", None), ("2024-1-5", 0), ("2024-13-01", 0)], "t string, d int")
    assert [r[0] for r in rows.select(text.note_day(F.col("t"), F.col("d"))).collect()] == ["2024-02-01", "unknown", "unknown", "unknown", "2024-03-01", "2024-01-01", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize(
    ("whole", "chars", "want"),
    [("aaaa\n\nbbbb\ncccc", 8, ["aaaa", "bbbb\ncccc"]), ("x" * 20, 8, ["x" * 20]), ("aa\nbb\ncc\ndd\nee", 5, ["aa", "bb", "cc\ndd\nee"]), ("short", 8, ["short"]), (" " * 9, 8, []), ("\n" + "y" * 9, 8, ["y" * 9])],
)
def test_chunks(spark, whole, chars, want):
    assert column(spark, [whole], "string", lambda x: text.chunks(x, chars)) == [want]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), min_size=20, max_size=20))
def test_chunks_hold_the_text(spark, xs):
    for whole, got in zip(xs, column(spark, xs, "string", lambda x: text.chunks(x, 7)), strict=True):
        at = 0
        for c in got:
            found = whole.find(c, at)
            assert found >= 0 and not whole[at:found].strip()
            at = found + len(c)
        assert not whole[at:].strip() or len(whole) <= 7


def test_split_at_newline(spark):
    rows = spark.createDataFrame([("a\n\nb\nc", 4), ("abc", 5), ("abc", 2), ("\n\nabc", 3)], "x string, n int")
    got = [tuple(r[0]) for r in rows.select(text.split_at_newline(F.col("x"), F.col("n"))).collect()]
    assert got == [("a", "b\nc"), ("abc", ""), ("abc", ""), ("", "abc")]


def test_budgets(spark):
    rows = spark.createDataFrame([(0, 10), (2048, 400), (8192, 40000), (16384, 65000)], "last long, n int")
    prompt = F.repeat(F.lit("x"), F.col("n"))
    assert [tuple(r) for r in rows.select(budgets.within_context(F.col("last"), prompt), budgets.doubled(F.col("last"))).collect()] == [(2048, 2048), (4096, 4096), (6128, 16384), (512, 16384)]


def test_ids(spark):
    assert column(spark, ["r1_0", "R1_0", "r1", "r1_0\n", "5"], "string", ids.is_valid_id) == [True, False, False, False, False]
    assert [tuple(x) for x in column(spark, ["A/b", "A/", "/b", "A", "A/b/c"], "string", ids.split_ref)] == [("A", "b"), (None, None), (None, None), (None, None), ("A", "b")]
    assert column(spark, [[12, 10, 11, 10]], "array<bigint>", ids.dense_renumber) == [{10: 0, 11: 1, 12: 2}]
    assert column(spark, ["r12_3", "x"], "string", lambda x: ids.remapped_id(x, ids.dense_renumber(F.array(*[F.lit(n).cast("bigint") for n in (12, 10)])))) == ["r1_3", "x"]


def test_json_valid(spark):
    assert column(spark, ["[]", "1", "null", "NaN", '{"a":1,"a":2}', "", "[1] x", "{'a':1}", "[1,]", "01", None], "string", jsontext.json_valid) == [True] * 5 + [False] * 6


def test_merge():
    assert jsontext.merge(["[1]", '{"a":2}']) == ('[1, {"a": 2}]', True)
    assert jsontext.merge(["[1]", "oops", "x"]) == ("oops", False)
    assert jsontext.merge([]) == ("[]", True)


def test_remap():
    chain = json.dumps([{"id": "r2_0"}, {"id": "r1_0"}, {"a": {"reference": "Lab/r2_0"}}])
    assert json.loads(jsontext.remap(chain)[0])[2]["a"]["reference"] == "Lab/r1_0"
    assert jsontext.remap("oops")[1].startswith("JSON parse error: ")
    assert jsontext.remap("{}")[1] == "top-level value is not a JSON array"
    assert jsontext.remap('[{"id":"x1"}]')[1] == "invalid id(s): ['x1']"
    assert jsontext.remap('[{"a":1}]') == ('[{"a":1}]', None)
    assert jsontext.remap('[{"id": "r0_1"}, {"id": "r5_0"}]') == ('[{"id": "r0_1"}, {"id": "r5_0"}]', None)
    assert jsontext.remap(None)[1].startswith("JSON parse error: ")


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5)), min_size=1, max_size=8))
def test_remap_is_idempotent_and_keeps_order(pairs):
    once, reason = jsontext.remap(json.dumps([{"id": f"r{a}_{b}"} for a, b in pairs]))
    assert reason is None and jsontext.remap(once) == (once, None)
    after = [int(x["id"][1:].split("_")[0]) for x in json.loads(once)]
    assert all((a < c) == (x < y) for (a, _), x in zip(pairs, after, strict=True) for (c, _), y in zip(pairs, after, strict=True))


def test_prompts(spark):
    rows = spark.createDataFrame([("2024-01-01", "Note."), (None, "Note."), ("2024-01-01", None)], "d string, t string")
    assert [r[0] for r in rows.select(prompts.prompt("sharded", F.col("d"), F.col("t"))).collect()] == ["Extract concepts from the following clinical note.\n\nNote date: 2024-01-01.\nNote.", "Extract concepts from the following clinical note.\n\nNote date: None.\nNote.", None]
    assert prompts.response_template("Qwen3-gemma") == "<|im_start|>assistant\n"
    assert prompts.response_template("gemma-2") == "<start_of_turn>model\n"
    with pytest.raises(NotImplementedError):
        prompts.response_template("other")


def test_paths(spark):
    assert column(spark, ["file:/a/b/c.tar.gz", "x"], "string", text.stem) == ["c.tar", "x"]
    assert column(spark, ["file:/a/b/c.CSV"], "string", text.extension) == [".csv"]
    assert column(spark, ["file:/a/b/c.csv"], "string", text.parent_name) == ["b"]


ODD_RESOURCES = [
    "[]", "{}", "7", "null", "oops", "", "[1] x", "[{}], {}", "[{}]}", '[{"id": "r1_0"}] ', "[NaN]", '[{"id": "r1_0", "id": "r2_0"}]', '[{"id":null}]', '[{"id":5}]', '[{"id":"it\'s"}]', '[{"id":"r٣_1"}]',
    '[{"id":"r007_1"},{"a":{"id":"r7_1","reference":"x/r007_1"}}]', '[{"id": "r3_0", "a": {"reference": "r3_0"}, "b": {"reference": "Lab/x/r3_0"}, "c": {"id": "r3_0"}}]',
    '[{"id" :\n"r4_2","text":"say \\"id\\": \\"r4_2\\" or \\\\","reference":["Lab/r4_2"]},{"id":"r9_0","k\\"id":"r4_2","reference":"Lab/r4_2"}]',
    '[{"\\u0069d":"r5_0"},{"id":"r6_0"}]', '[{"id":"r5\\u005f0"}]', '[{"id":"r6_0","reference":"a\\/r6_0"}]', '[{"id":"r1_1"},["r1_1",{"id":"r1_1"}],{"id":"r12_1"}]', '[{"id":"r99999999999999999999_0"}]', '[{"id":"Größe"}]', '[{"id":"x1"},{"id":"r1_1"},{"id":"y"}]', '[{"a":""},{"id":"r2_2"}]',
]


def test_native_renumbering_equals_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD_RESOURCES, None])], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", jsontext.renumbered(F.col("t")).alias("x")).collect()}
    value = lambda t: json.loads(t) if t is not None and t.strip() else t
    for i, t in enumerate([*ODD_RESOURCES, None]):
        text, reason = jsontext.remap(t)
        if got[i] is not None:
            assert got[i].reason == reason, t
            assert (got[i].text == t) if text == t else (value(got[i].text) == value(text)), t
    left = {t for i, t in enumerate([*ODD_RESOURCES, None]) if got[i] is None}
    assert left == {"oops", "", "[1] x", "[{}], {}", "[{}]}", "[NaN]", *[t for t in ODD_RESOURCES if "\\u" in t or "\\/" in t or "" in t or "null}" in t or ":5}" in t or "it's" in t or "٣" in t or '"id": "r2_0"' in t or "99999" in t or "Größe" in t]}


def test_strict_json_takes_whole_texts_alone(spark):
    texts = ["[1]", " [1] ", "[1] x", "[1],2", '[1],"z":0} x', "[1]]", "{}}", "", "nul", "'a'", '""', '{"a":1,"a":2}', "[NaN]", '"\\ue000"', "1e5", "[1]//x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i for r in rows.where(jsontext.strict_json(F.col("t")).isNotNull()).collect()}
    assert [texts[i] for i in sorted(got)] == ["[1]", " [1] ", "1e5"]
