"""Document goldens, edge cases and the inference runtime with scripted models."""

from __future__ import annotations

import json
import pickle

import pytest
from pyspark.sql import functions as F

from notewright.functions.jsontext import json_valid
from notewright.operators import annotations, flatten, gold, inference, metrics, prepare, remap, retry, tokens
from notewright.plans import structured
from notewright.plans.inference import SERVERS, RuleModel
from notewright.schemas import ANNOTATION_LOG, CODES, GOLD_ENTITY, GOLD_FIELDS, REFS
from notewright.sources import annotation_log, ranged, readers, sinks
from notewright.streaming import shards
from tests.compare import SMALL

FIRST = [
    {"id": "r10_0", "resourceType": "FamilyHistory", "status": "present", "relationship": "Mother", "description": "Breast cancer", "timestamp": "2023-01-01"},
    {"id": "r11_0", "resourceType": "Procedure", "status": "planned", "schedule_info": "next month", "description": "Colonoscopy", "bodySite": ["Colon"], "timestamp": "2024-07-20"},
    {"id": "r12_0", "resourceType": "Medication", "status": "stopped", "description": "furosemide 40 mg", "ingredient": {"text": "furosemide", "strength": {"numerator": {"value": 40, "unit": "mg"}, "denominator": {"value": 1, "unit": "tablet"}}}, "dosageInstruction": {"text": "Take half", "quantity": {"value": 0.5, "unit": "tablet"}, "timing": {"frequency": 2, "period": 1, "periodUnit": "d"}}, "evidence": [{"detail": [{"reference": "Symptom/r12_1"}]}]},
    {"id": "r12_1", "resourceType": "Symptom", "status": "present", "description": "Upset"},
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_flatten_document(spark):
    notes = frame(spark, [(1, json.dumps(FIRST)), (2, "[]"), (3, ""), (4, None), (5, "{}"), (6, '[{"id": "r0_0"}, 7, {"id": "r1_0"}]')], "note int, payload string")
    got = {(r.note, r.resource_index): r for r in flatten.codes(notes, "note", "payload").collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (6, 0), (6, 2)]
    assert list(got[1, 0].asDict())[1:] == list(CODES)
    assert got[1, 1].body_site == '["Colon"]' and got[1, 1].schedule_info is None and got[1, 0].relationship == "Mother"
    m = got[1, 2]
    assert (m.ingredient_text, m.ingredient_strength_numerator_value, m.ingredient_strength_denominator_unit, m.dosageInstruction_value, m.timing_frequency, m.timing_period_unit) == ("furosemide", "40", "tablet", "0.5", "2", "d")
    assert flatten.codes(notes, "note", "payload", both_schedules=True).where("note = 1 AND resource_index = 1").first().schedule_info == "next month"
    edges = flatten.refs(notes, "note", "payload").collect()
    assert [list(r.asDict())[1:] for r in edges] == [list(REFS)]
    assert tuple(edges[0])[1:] == (2, "Medication", "r12_0", "$.evidence[0].detail[0]", "evidence", "Symptom/r12_1", "Symptom", "r12_1")
    assert {r.note: r.note_status for r in flatten.manifest(notes, "note", "payload").collect()} == {1: "ok", 2: "ok_empty", 3: "skipped", 4: "skipped", 5: "error", 6: "ok"}


def test_value_string(spark):
    shapes = ["Pos", {"text": "x"}, 5, {"text": 5}]
    notes = frame(spark, [(i, json.dumps([{"valueString": s}])) for i, s in enumerate(shapes)], "note int, payload string")
    assert [r.valueString for r in flatten.codes(notes, "note", "payload").orderBy("note").collect()] == ["Pos", "x", None, None]


def test_refs_need_a_sole_key_and_walk_deep(spark):
    deep = {"reference": "A/b"}
    for _ in range(150):
        deep = {"x": [deep]}
    notes = frame(spark, [(1, json.dumps([{"a": {"reference": "A/b", "display": "x"}}, deep]))], "note int, payload string")
    (edge,) = flatten.refs(notes, "note", "payload").collect()
    assert edge.src_resource_index == 1 and edge.relation is None and edge.path.count("[0]") == 150


def test_remap_rows(spark):
    rows = frame(spark, [(1, json.dumps(FIRST)), (2, "oops"), (3, '[{"id": "bad"}]')], "k int, payload string")
    clean, invalid = remap.remap_ids(rows, "payload")
    (one,) = clean.collect()
    fixed = json.loads(one.payload)
    assert [r["id"] for r in fixed] == ["r0_0", "r1_0", "r2_0", "r2_1"] and fixed[2]["evidence"][0]["detail"][0]["reference"] == "Symptom/r2_1"
    assert invalid.columns[0] == "invalid_reason" and sorted(r.k for r in invalid.collect()) == [2, 3]


def test_dedupe_keeps_first_and_one_null(spark):
    rows = frame(spark, [(0, None), (1, None), (2, "a"), (3, "a")], "i int, text string")
    assert sorted(r.i for r in prepare.dedupe_keep_first(rows.repartition(4), "text", ["i"]).collect()) == [0, 2]


@pytest.mark.parametrize("parts", [1, 7])
def test_split_is_by_group(spark, parts):
    rows = frame(spark, [(i, i % 11) for i in range(100)] + [(100, None)], "i int, g int").repartition(parts)
    split = prepare.group_split(rows, "g").collect()
    train, rest = {r.g for r in split if r.split == "train"}, {r.g for r in split if r.split == "eval"}
    assert len(split) == 101 and len(train) == 8 and not train & rest and None in rest
    assert train == {r.g for r in prepare.group_split(rows.repartition(3), "g").where("split = 'train'").collect()}
    assert prepare.split_overlap(prepare.group_split(rows, "g"), "g").isEmpty()


def test_sample_and_defaults(spark):
    rows = frame(spark, [(i,) for i in range(50)], "i int")
    assert [r.i for r in prepare.sample_exact(rows, "i", 5).collect()] == [r.i for r in prepare.sample_exact(rows.repartition(9), "i", 5).collect()]
    assert prepare.sample_exact(rows, "i", 99).count() == 50
    assert prepare.with_defaults(rows, {"i": ("int", 9), "j": ("int", 7)}).where("i = 3 AND j = 7").count() == 1
    assert prepare.text_of(rows.select("i", F.lit("x").alias("t")), "i", 3, "t") == "x"
    with pytest.raises(KeyError):
        prepare.text_of(rows.select("i", F.lit("x").alias("t")), "i", 99, "t")


def test_metric_golden(spark):
    raw = "ROW_ID int, entity string, a string, b string"
    as_mentions = lambda rows: metrics.mentions(frame(spark, rows, raw), "ROW_ID", F.col("entity"), F.col("a"), F.col("b"))
    gold_ = as_mentions([(1, "htn", None, None), (1, "na", "140", None), (1, "na", None, "141"), (1, "k", "3.5", None), (2, "a", "1", None), (3, "a", "1", None), (3, "b", "2", None), (3, " ", "2", None)])
    pred = as_mentions([(1, "HTN", None, None), (1, "Na", "140.0", None), (1, "glucose", "5", None), (2, "z", "1", None)])
    present = frame(spark, [(1,), (2,), (2,)], "ROW_ID int")
    rows = {r.ROW_ID: tuple(r)[1:] for r in metrics.row_metrics(gold_, pred, present).collect()}
    assert rows == {1: (4, 3, 2, 2, 0.5, 1.0, 0.5, False), 2: (1, 1, 0, 0, 0.0, 0.0, 0.0, False), 3: (2, 0, 0, 0, 0.0, None, 0.0, True)}
    s = metrics.summary(metrics.row_metrics(gold_, pred, present)).first()
    assert tuple(s)[:5] == (3, 1, 7, 2, 2) and s.micro_value_accuracy_given_entity_match == 1.0 and s.macro_value_accuracy_given_entity_match == 0.5
    merged = metrics.merged(gold_, pred, present).collect()
    assert len(merged) == 5 and sum(r.values_pred == "140" for r in merged) == 2
    empty = metrics.summary(metrics.row_metrics(gold_.limit(0), pred, present)).first()
    assert empty.n_rows == 0 and empty.micro_entity_recall is None


def test_gold(spark):
    cell = lambda t, f, k, v: (t, f, k, v)
    data = [[cell("lab", "value", "int", "1"), cell("lab", "value", "str", "1")], [cell("lab", "value", "int", "1"), cell("lab", "value", "str", "nan"), cell("x", "value", "str", "b"), cell("label", "value", "str", "no")], [cell("empty", None, None, None)]]
    rows = frame(spark, [("n", "0", "e", "t", data), ("n", "0", "none", "t", []), ("n", "0", "none", "t", None)], GOLD_ENTITY)
    got = {r.entity_text: r for r in gold.flatten(rows).collect()}
    assert got["e"].value == "1 | 1 | b" and got["none"].value is None and list(got["e"].asDict()) == ["ROW_ID", "position", "entity_text", "entity_type", *GOLD_FIELDS]
    entries = gold.flatten_entries(rows, fields=["value"]).collect()
    assert sorted((r.entity_text, r.value or "") for r in entries) == [("e", ""), ("e", "1"), ("e", "b"), ("none", "")]
    assert sorted((r.tbl, r.field or "") for r in gold.discover(rows).collect()) == [("empty", ""), ("lab", "value"), ("x", "value")]


def test_gold_files(spark, tmp_path):
    document = {7: [{"htn": {"position": 3, "entity_type": "d", "data": [{"lab": {"value": 1, "valuenum": None}, "label": "x"}, {"none": {}}]}}, {"a": {}, "b": {}}, "odd"]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pkl").write_bytes(pickle.dumps(document))
    (tmp_path / "p" / "x.json").write_text(json.dumps(document))
    a, b = readers.gold_pickles(spark, str(tmp_path)).collect(), readers.gold_json(spark, str(tmp_path)).collect()
    assert a == b and a[0].ROW_ID == "7" and [[tuple(c) for c in e] for e in a[0].data] == [[("lab", "value", "int", "1"), ("lab", "valuenum", "NoneType", None)], [("none", None, "NoneType", None)]]

    class Bad:
        def __reduce__(self):
            return (print, ("run",))

    (tmp_path / "p" / "y.pkl").write_bytes(pickle.dumps(Bad()))
    with pytest.raises(Exception, match="not plain data"):
        readers.gold_pickles(spark, str(tmp_path)).collect()


class Scripted:
    """Fails and succeeds by the prompt's words."""

    async def complete(self, server, prompt, max_tokens):
        if server == "down" or "unreachable" in prompt:
            raise ConnectionError(server)
        if "boom" in prompt:
            raise RuntimeError("boom")
        return json.dumps([max_tokens]) if "hard" not in prompt or max_tokens > 2048 else "["


def test_infer_statuses(spark):
    rows = frame(spark, [(1, "ok", 2048), (2, "boom", 2048), (3, None, 2048), (4, "hard", 2048), (5, "unreachable", 1)], "k int, prompt string, t long").coalesce(1)
    got = {r.k: r for r in inference.infer(rows, Scripted, ["down", "up"], "prompt", "t", "out").collect()}
    assert [got[k].out_status for k in range(1, 6)] == ["success", "error", "error", "success", "error"]
    assert got[1].out == "[2048]" and got[2].out_error == "boom" and got[4].out == "[" and got[5].out is None


def test_attempts_take_only_invalid_rows(spark, tmp_path):
    rows = frame(spark, [(1, "ok"), (2, "hard"), (3, "boom")], "k int, prompt string")
    path = str(tmp_path / "attempts")
    first = {r.k: r for r in inference.run_attempt(rows, path, Scripted, ["up"], "k").collect()}
    assert [first[k].valid_output for k in (1, 2, 3)] == [True, False, False] and first[3].concepts_error == "boom"
    again = {r.k: r for r in inference.run_attempt(rows, path, Scripted, ["up"], "k").collect()}
    assert again[2].concepts == "[4096]" and again[1].concepts == "[2048]" and again[2].valid_output
    assert sorted(r.k for r in spark.read.parquet(f"{path}/attempt=2").collect()) == [2, 3]
    with pytest.raises(ValueError, match="no key"):
        inference.run_attempt(rows.union(rows), path, Scripted, ["up"], "k")


def test_reports(spark):
    state = frame(spark, [("a", "success"), ("a", "error"), ("b", "error"), ("c", None)], "f string, concepts_status string")
    report = inference.file_report(state, "f")
    assert sorted(tuple(r) for r in report.collect()) == [("a", 2, 1, 1), ("b", 1, 0, 1), ("c", 1, 0, 0)]
    assert tuple(inference.totals(report).first()) == (3, 4, 1, 2)
    assert [r.f for r in inference.failures(report, "f").collect()] == ["b", "c"]


def test_retry(spark):
    rows = frame(spark, [(1, None, "x", False), (2, "2024-01-01", "boom", False), (3, None, " " * 4001, False), (4, None, "x", True), (5, None, "x\n" * 3000, False), (6, None, "x", None)], "k int, d string, t string, valid_output boolean")
    got = {r.k: r for r in retry.retry(rows, Scripted, ["up"], "k", "d", "t").collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert (got[1].retry_output, got[1].retry_valid, got[1].retry_chunks) == ("[2048]", True, 1)
    assert (got[2].retry_output, got[2].retry_valid, got[2].retry_exhausted) == ("", False, True)
    assert (got[3].retry_output, got[3].retry_valid, got[3].retry_chunks) == ("[]", True, 0)
    assert (got[5].retry_output, got[5].retry_chunks, json.loads(got[5].retry_chunk_outputs)) == ("[2048, 2048]", 2, ["[2048]", "[2048]"])
    state = retry.overall(retry.applied(rows.withColumn("concepts", F.lit("[0]")), frame(spark, list(got.values()), "k int, retry_output string, retry_valid boolean, retry_chunks long, retry_chunk_outputs string, retry_prompt string, retry_exhausted boolean"), "k"))
    assert {r.k: (r.overall_output, r.overall_valid) for r in state.collect()} == {1: ("[2048]", True), 2: ("", False), 3: ("[]", True), 4: ("[0]", True), 5: ("[2048, 2048]", True), 6: (None, False)}
    assert tuple(retry.report(state).first()) == (6, 1, 4, 3, 1, 4)
    resumed = retry.resume(rows, state, "k")
    assert sorted(r.k for r in retry.todo(resumed).collect()) == [2]


def test_mask_and_pad(spark):
    rows = frame(spark, [(1, [9, 1, 2, 5, 6, 1, 2, 7]), (1, [9, 1, 2]), (2, [1]), (2, [])], "b int, ids array<int>")
    marks = [1, 2]
    masked = rows.select("b", "ids", tokens.mask_labels(F.col("ids"), marks).alias("labels"))
    assert [r.labels for r in masked.collect()] == [[-100, -100, -100, 5, 6, 1, 2, 7], [9, 1, 2], [1], []]
    padded = {(r.b, tuple(r.ids)): r.labels for r in tokens.pad_labels(masked, "b").collect()}
    assert padded[1, (9, 1, 2)] == [9, 1, 2] + [-100] * 5 and padded[2, ()] == [-100]


def test_lengths(spark):
    rows = frame(spark, [(1,), (2,), (3,), (4,)], "length int")
    assert tuple(tokens.length_stats(rows).first()) == (1, 4, 2.5, 3)
    assert tuple(tokens.filter_report(rows, 3).first()) == (4, 1, 25.0) and tokens.filter_report(rows.limit(0), 3).first().percent_removed is None


def word_tokenizer():
    return lambda s: [len(w) for w in s.split(" ")]


def test_training_features(spark):
    pairs = frame(spark, [("a b", "c")], "input string, output string")
    (r,) = tokens.training_features(pairs, "qwen", word_tokenizer).collect()
    assert r.length == len(r.input_ids) == len(r.labels) and set(r.attention_mask) == {1}
    assert tokens.typed(spark.createDataFrame([r])).schema.simpleString() == "struct<input_ids:array<int>,attention_mask:array<tinyint>,labels:array<bigint>>"


def test_annotations(spark, tmp_path):
    doc = {"row_1": {"status": {"correct": False, "corrected_value": "active", "comment": "ü"}, "kind": {"correct": True}, "odd": 3}, "row_2": "odd", "_meta": {"note_id": "N1", "last_updated": "t"}}
    (tmp_path / "x_annotations.json").write_text(json.dumps(doc))
    log = readers.annotation_documents(spark, str(tmp_path))
    current = annotations.latest(log)
    rows = sorted(tuple(r) for r in annotations.export(current).collect())
    assert rows == [("N1", "row_1", "kind", "true", "", ""), ("N1", "row_1", "status", "false", "active", "ü")]
    assert tuple(annotations.progress(current).first()) == ("N1", 2, "t")
    new = frame(spark, [("N1", "row_1", {"kind": (False, "y", None)}, 5, "u")], ANNOTATION_LOG)
    after = annotations.latest(annotations.upsert(log.select(*new.columns), new))
    assert [r.field for r in annotations.export(after).where("row_key = 'row_1'").collect()] == ["kind"]
    with pytest.raises(ValueError, match="row_key"):
        annotations.upsert(log, frame(spark, [("N1", "", None, 5, "u")], ANNOTATION_LOG))
    out = tmp_path / "out.csv"
    sinks.annotation_export(annotations.export(after), str(out))
    with pytest.raises(ValueError, match="no annotations"):
        sinks.annotation_export(annotations.export(after).limit(0), str(tmp_path / "none"))
    saved = json.loads(annotations.documents(after).first().document)
    assert saved["_meta"] == {"note_id": "N1", "last_updated": "u"} and saved["row_1"]["kind"]["corrected_value"] == "y"
    assert annotations.stamped(new).first().updated_at.endswith("Z")


def test_files(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "b.csv").write_text('id,TEXT\n1,"two\nlines, ""q"""\n')
    (data / "a.tsv").write_text("id\tx\n1\t2\n")
    (data / "b.txt").write_text("  note\n")
    assert [tuple(r) for r in readers.catalogue(spark, str(data)).collect()] == [("a.tsv", False), ("b.csv", True)]
    assert readers.table(spark, str(data / "b.csv")).first().TEXT == 'two\nlines, "q"'
    assert readers.table(spark, str(data / "a.tsv")).columns == ["id", "x"]
    with pytest.raises(ValueError, match="unsupported"):
        readers.table(spark, "x.doc")
    tree = readers.csv_tree(spark, str(data)).first()
    assert tree.category == "data" and tree.TEXT.startswith("two")
    named = frame(spark, [("file:/z/b.csv",), ("file:/z/c.csv",)], "f string")
    assert sorted(r.note_text for r in readers.with_note_text(named, readers.sidecars(spark, str(data)), "f").collect()) == ["", "note"]
    df = frame(spark, [("a", "é", "x/p.parquet"), (None, "b", "y/p.parquet")], "input string, output string, file_path string")
    sinks.json_lines(df, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ['{"input":"a","output":"é"}', '{"input":null,"output":"b"}']
    assert readers.training_pairs(spark, str(tmp_path / "lines")).count() == 2
    sinks.by_shard(df, str(tmp_path / "shards"))
    back = readers.shards(spark, str(tmp_path / "shards"))
    assert back.count() == 2 and (tmp_path / "shards" / "shard_dir=x").is_dir()
    assert readers.shards(spark, str(tmp_path / "nothing" / "*.parquet")) is None
    sinks.parquet(df.select("input"), str(tmp_path / "one"))
    assert ranged.parquet_metadata(spark, str(tmp_path / "one")).where("file like '%parquet'").count() >= 1
    sinks.report(df.select("output"), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1
    sinks.flat_tables(df.select("input", "output"), df.select("input"), str(tmp_path / "flat"), "input", 4)
    assert spark.read.parquet(str(tmp_path / "flat" / "codes")).count() == 2


def test_stream(spark, tmp_path):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), tmp_path / "log"
    source.mkdir()
    spark.range(5).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: shards.run_available(shards.shards(spark, str(source), "id long"), lambda df: df.select(F.col("id") * 2), out, str(tmp_path / "c"))
    run()
    run()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 7).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert spark.read.parquet(out).count() == 7
    frame(spark, [("n", "r", None, 1, "a"), ("n", "r", None, 2, "b"), ("n", "s", None, 1, "a")], ANNOTATION_LOG).write.parquet(str(log))
    shards.keep_latest(spark.readStream.schema(ANNOTATION_LOG).parquet(str(log)), str(tmp_path / "kept"), str(tmp_path / "c2"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 2]


def test_empty_tables(spark):
    notes = frame(spark, [], "note int, payload string")
    assert flatten.codes(notes, "note", "payload").isEmpty() and flatten.refs(notes, "note", "payload").isEmpty()
    assert notes.select(json_valid(F.col("payload"))).isEmpty()
    assert prepare.dedupe_keep_first(notes, "payload", ["note"]).isEmpty()
    assert prepare.group_split(notes, "note").isEmpty()


def test_texts_for_python_alone_reach_it(spark):
    """Rows that the strict reader refuses are parsed, renumbered and told apart like the others, and plans of plain notes hold no Python."""
    texts = ['[{"id": "r2_0", "v": NaN, "e": [{"reference": "A/r2_0"}]}]', '[{"id": "r1_0", "id": "r3_0"}]', "[{}] x", '[{"id": "r4_0", "e": [{"reference": "A/r4_0"}]}]', '[{"\\u0069d": "r5_0"}]', None]
    notes = frame(spark, list(enumerate(texts)), "k int, payload string")
    assert {r.k: r.note_status for r in flatten.manifest(notes, "k", "payload").collect()} == {0: "ok", 1: "ok", 2: "error", 3: "ok", 4: "ok", 5: "skipped"}
    assert {r.k: r.id for r in flatten.codes(notes, "k", "payload").collect()} == {0: "r2_0", 1: "r3_0", 3: "r4_0", 4: "r5_0"}
    assert {(r.k, r.target_id) for r in flatten.refs(notes, "k", "payload").collect()} == {(0, "r2_0"), (3, "r4_0")}
    clean, invalid = remap.remap_ids(notes, "payload")
    assert {r.k: json.loads(r.payload)[0]["id"] for r in clean.collect()} == {0: "r0_0", 1: "r0_0", 3: "r0_0", 4: "r0_0"} and {r.k for r in invalid.collect()} == {2, 5}
    plain = notes.where("k = 3")
    for df in (flatten.codes(plain, "k", "payload"), flatten.refs(plain, "k", "payload"), remap.remap_ids(plain, "payload")[0]):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1


def test_batches_of_texts_are_encoded_in_order(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 7)
    texts = ["ab", None, "", "a much longer text than a batch", "c", None, "dé", ""]
    rows = frame(spark, list(enumerate(texts)), "i int, t string").coalesce(1)
    encode = tokens.batch_encoder(lambda: lambda batch: [[ord(c) for c in t] for t in batch])
    assert [r.x for r in rows.select("i", encode(F.col("t")).alias("x")).orderBy("i").collect()] == [None if t is None else [ord(c) for c in t] for t in texts]
    assert rows.where("i < 0").select(encode(F.col("t"))).collect() == [] and [r[0] for r in rows.where("i = 1").select(encode(F.col("t"))).collect()] == [None]


class Lost:
    """One server is down, one refuses, others answer."""

    async def complete(self, server, prompt, max_tokens):
        if server.startswith("down"):
            raise ConnectionError(server)
        if prompt == "bad":
            raise ValueError("refused")
        return f"{prompt}:{max_tokens}"


@pytest.mark.parametrize("parts", [1, 6])
def test_servers_that_fail_are_left_out_for_all(spark, parts):
    rows = frame(spark, [(i, "bad" if i == 7 else None if i == 8 else f"p{i}", 16) for i in range(90)], "k int, prompt string, most int").repartition(parts)
    ask = lambda servers, **more: {r.k: r for r in inference.infer_in_rounds(rows, Lost, servers, "k", "prompt", "most", "out", **more).collect()}
    some = ask(["down1", "up1", "down2", "up2"])
    assert len(some) == 90 and all(r.out_attempts <= 3 for r in some.values())
    assert all(r.out == f"p{k}:16" and r.out_status == "success" and r.out_error is None for k, r in some.items() if k not in (7, 8))
    assert (some[7].out, some[7].out_error, some[8].out_error, some[8].out_attempts) == (None, "refused", "no prompt", 0)
    none = ask(["down1", "down2"])
    assert {r.out_error for k, r in none.items() if k != 8} == {"all servers are unreachable"} and len(none) == 90
    once = ask(["down1", "up1"], attempts=1)
    assert {r.out_status for r in once.values()} == {"success", "error"} and max(r.out_attempts for r in once.values()) == 1


def entry(spark, *rows):
    mark = {"f": {"correct": True, "corrected_value": None, "comment": None}}
    return frame(spark, [(n, k, mark, seq, "t") for n, k, seq in rows], ANNOTATION_LOG)


def test_compaction_may_die_anywhere(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    now = lambda: sorted((r.note_id, r.row_key, r.seq) for r in annotation_log.current(spark, path).collect())
    assert now() == []
    annotation_log.append(entry(spark, ("n", "a", 1), ("n", "b", 5)), path)
    annotation_log.append(entry(spark, ("n", "a", 2), ("m", "a", 3)), path)
    want = [("m", "a", 3), ("n", "a", 2), ("n", "b", 5)]
    assert now() == want
    with monkeypatch.context() as m:  # it dies before anything is removed
        m.setattr(annotation_log, "remove", lambda spark, folders: None)
        annotation_log.compact(spark, path)
    assert now() == want and len(list(tmp_path.glob("batches/*"))) == 2
    annotation_log.remove(spark, [str(next(tmp_path.glob("batches/*")))])  # while it removes
    assert now() == want
    broken = tmp_path / "bases" / "9-unfinished"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")  # and while it writes
    assert now() == want
    annotation_log.append(entry(spark, ("n", "b", 4), ("n", "a", 9)), path)
    annotation_log.compact(spark, path)
    assert now() == [("m", "a", 3), ("n", "a", 9), ("n", "b", 5)]
    assert not list(tmp_path.glob("batches/*")) and len(list(tmp_path.glob("bases/*/_SUCCESS"))) == 1


def test_members_come_one_by_one(tmp_path):
    import io

    documents = [{"a": [1, {"b": "x\\"}], "é": "ü" * 50, "n": 1234.5}, {}, {"last": [{}] * 9}]
    raw = "\n ".join(json.dumps(d, ensure_ascii=False) for d in documents).encode()
    for chunk in (1, 2, 7, 1000):
        assert list(ranged.members(io.BytesIO(raw), chunk)) == [(k, v) for d in documents for k, v in d.items()]
    for bad in (b'{"a": 1', b'{"a" 1}', b"[1]", b'{"a": 1} x'):
        with pytest.raises(ValueError):
            list(ranged.members(io.BytesIO(bad)))
    assert list(ranged.members(io.BytesIO(b" \n"))) == []


def test_nested_files_equal_whole_ones(spark, tmp_path):
    document = {i: [{f"e{j}": {"position": j, "entity_type": "d", "data": [{"lab": {"value": i}, "label": "x"}, {"none": {}}]}} for j in range(3)] for i in range(40)}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pkl").write_bytes(pickle.dumps(document))
    (tmp_path / "p" / "x.json").write_text(json.dumps(document))
    found = ranged.gold_files(spark, str(tmp_path))
    whole = readers.gold_pickles(spark, str(tmp_path)).unionByName(readers.gold_json(spark, str(tmp_path)))
    assert found.rdd.getNumPartitions() == 2 and found.count() == 240 and found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()


def test_footers_are_read_alone(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    class Counting:
        def __init__(self, path):
            self.file, self.taken, self.closed = open(path, "rb"), 0, False

        def read(self, n=-1):
            got = self.file.read(n)
            self.taken += len(got)
            return got

        def seek(self, *at):
            return self.file.seek(*at)

        def tell(self):
            return self.file.tell()

    path = str(tmp_path / "big.parquet")
    pq.write_table(pa.table({"x": [os.urandom(64) for _ in range(1 << 16)]}), path)
    file = Counting(path)
    assert ranged.read_footer(file).num_rows == 1 << 16 and os.path.getsize(path) > 4 << 20 and file.taken <= 1 << 17


def test_shards_that_drift(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) as n").write.parquet(str(tmp_path / "a"))
    spark.range(3, 5).selectExpr("id", "'x' as n", "1 as extra").write.parquet(str(tmp_path / "b"))
    spark.range(5, 7).selectExpr("cast(id as int) id").write.parquet(str(tmp_path / "c"))
    got = ranged.declared_shards(spark, str(tmp_path), "id long, n long, more string", {"more": "none", "n": 7}).orderBy("id").collect()
    assert [(r.id, r.n, r.more) for r in got] == [(0, 0, "none"), (1, 1, "none"), (2, 2, "none"), (3, None, "none"), (4, None, "none"), (5, 7, "none"), (6, 7, "none")]
    told = {(r.file.rsplit("/", 2)[1], r.column, r.declared, r.found) for r in ranged.drift(spark, str(tmp_path), "id long, n string").collect()}
    assert told == {("c", "id", "bigint", "int"), ("c", "n", "string", None)}


def test_a_keyed_table_reads_few_rows_for_one_key(spark, tmp_path):
    spark.range(200_000).selectExpr("id * 7 % 200000 AS ROW_ID", "concat('text ', id) AS TEXT").write.parquet(str(tmp_path / "plain"))
    notes = spark.read.parquet(str(tmp_path / "plain"))
    sinks.keyed(notes, str(tmp_path / "keyed"), "ROW_ID", 4)
    assert prepare.text_of(spark.read.parquet(str(tmp_path / "keyed")), "ROW_ID", 1234, "TEXT") == prepare.text_of(notes, "ROW_ID", 1234, "TEXT")

    lookup = spark.read.parquet(str(tmp_path / "keyed")).where((F.col("ROW_ID") == F.lit("1234").try_cast("bigint")) & (F.col("ROW_ID").cast("string") == "1234"))
    assert "EqualTo(ROW_ID,1234)" in lookup._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(KeyError):
        prepare.text_of(notes, "ROW_ID", "01234", "TEXT")

    def rows_read(path):
        df = spark.read.parquet(path).where("ROW_ID = 1234")
        assert df.count() == 1 and len(df.collect()) == 1
        plan, seen = df._jdf.queryExecution().executedPlan(), []
        todo = [plan]
        while todo:
            node = todo.pop()
            if "Scan parquet" in node.nodeName():
                seen.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return sum(seen)

    assert rows_read(str(tmp_path / "keyed")) <= 2_000 < rows_read(str(tmp_path / "plain"))


def test_codes_of_normal_values_need_no_python(spark):
    found = structured.flatten_codes(spark, SMALL)
    assert "EvalPython" not in found._jdf.queryExecution().toString()
    rows = frame(spark, [(1, "007"), (2, "1e3"), (3, None), (4, "-0.5"), (5, "-0"), (6, "2.50")], "k int, v string")
    assert {r.k: r.v for r in flatten.normalized(rows, ["v"]).collect()} == {1: "7", 2: "1000", 3: None, 4: "-0.5", 5: "0", 6: "2.5"}


def test_pruned_walk_goes_into_unlike_elements(spark):
    text = '[7, {"id": "r0_0", "a": [1, [{"reference": "A/r1_0"}]], "b": {"reference": {"reference": "B/r2_0"}}, "c": {"d": 1}}, {"reference": 5}]'
    edges = flatten.refs(frame(spark, [(1, text)], "k int, payload string"), "k", "payload").collect()
    assert {(r.src_resource_index, r.path, r.target_id) for r in edges} == {(1, "$.a[1][0]", "r1_0"), (1, "$.b.reference", "r2_0")}


def test_rounds_go_in_waves_of_bounded_tasks(spark, monkeypatch):
    rows = spark.range(100).select("id", F.concat(F.lit("x" * 50), F.col("id").cast("string")).alias("prompt"), F.lit(2048).alias("tokens"))

    def asked():
        return inference.infer_in_rounds(rows, RuleModel, SERVERS, "id", "prompt", "tokens", "out", in_flight=1, most_in_flight=2)

    answers = lambda df: {tuple(r)[:-1] for r in df.collect()}  # noqa: E731  all but the number of attempts
    whole = answers(asked())
    monkeypatch.setattr(inference, "WAVE_BYTES", 260)
    monkeypatch.setattr(inference, "BLOCK_ROWS", 4)
    waves = asked()
    assert waves.count() == 100 and answers(waves) == whole
    assert waves.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 25  # a task's rows, 50 before


def test_codes_are_written_once(spark, monkeypatch):
    names, write = [], flatten.written
    monkeypatch.setattr(flatten, "written", lambda df, name, **options: names.append(name) or write(df, name, **options))
    assert structured.flatten_codes(spark, SMALL).count() > 0 and len(names) == 1
    texts = ['[7, {"id": "r0_0", "valueQuantity": {"value": "1e3"}}, null]', '[{"id": "r1_0", "valueQuantity": {"value": 2.50}, "x": NaN}]', "[{}] x", None, "", "{}", "[]"]
    notes = frame(spark, list(enumerate(texts)), "k int, payload string")
    rows = flatten.codes(notes, "k", "payload", columns=["resource_index", "id", "valueQuantity_value"], numbers=["valueQuantity_value"]).collect()
    assert sorted(map(tuple, rows)) == [(0, 1, "r0_0", "1000"), (1, 0, "r1_0", "2.5")]


@pytest.mark.parametrize(("query", "tables"), [("resolve_refs", ["edges"]), ("capture_refs", ["edges"]), ("remap_ids", ["renumbered", "edges"])])
def test_references_are_read_and_written_once(spark, monkeypatch, query, tables):
    names, write = [], flatten.written
    for module in (flatten, remap):
        monkeypatch.setattr(module, "written", lambda df, name, **options: names.append(name) or write(df, name, **options))
    found = structured.QUERIES[query](spark, SMALL)
    assert found.count() > 0 and names == tables
    assert query != "remap_ids" or "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_named_references_of_texts_of_all_kinds(spark):
    """Objects alone are resources, whatever else lies among them or however their text must be read."""
    one = '{"id": "r0_0", "description": "d", "e": [{"reference": "A/r1_0"}]}'
    texts = [f"[7, {one}, null, [{one}]]", f'[{one}, {{"id": "r1_0", "x": NaN}}]', "[{}] x", None, "", one, "[]", '[{"reference": "A/r9_0"}]']
    notes = frame(spark, list(enumerate(texts)), "k int, payload string")
    edges, resources = flatten.named_refs(notes, "k", "payload")
    assert sorted(map(tuple, resources.collect()), key=str) == [(0, 1, "r0_0", "d"), (1, 0, "r0_0", "d"), (1, 1, "r1_0", None), (7, 0, None, None)]
    assert edges.columns == ["k", *REFS] and {(r.k, r.src_resource_index, r.path, r.target_id) for r in edges.collect()} == {(0, 1, "$.e[0]", "r1_0"), (1, 0, "$.e[0]", "r1_0"), (7, 0, "$", "r9_0")}
    own = flatten.refs(flatten.parsed(notes, "k", "payload"), "k", own=["description"])
    assert {(r.k, r.src_description) for r in own.collect()} == {(0, "d"), (1, "d"), (7, None)}
