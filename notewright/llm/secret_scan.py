"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are found per text. Weak parts - account identifiers, short
secrets, endpoints - say little alone; an interval join within a scope of code points, measured
between spans, reports a weak part only where both complementary parts lie nearby in the same text.

Spans are code-point positions, end exclusive. Defined results: a null or empty text has no
spans; rows are keyed by (doc_id, hash of the text), so repeated rows each get the same spans
and rows that share only their doc_id are scanned apart; a null doc_id is a key like any other;
an empty table gives an empty one; scan() reads no other columns, and redact() keeps them
whatever their names.

Work is in proportion to text and matches: positions are running sums by blocks, spans meet in
cells of the text, and redacted text is put together chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import checkpoint

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
#: What a match must have at least: length of which group.
LEAST = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32)}
#: Cheap necessary conditions, tested before the patterns that also need positions.
MAY_MATCH = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": BASE["hex"]}

WEAK = {
    "weak_id": r"""(?i:user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}|[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{2,}""",
    "weak_secret": r"""(?i:pass|pwd|passphrase|credential|auth|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""",
    "endpoint": r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])""",
}
MAY_WEAK = {"weak_id": r"@|(?i:user|login|account|client)", "weak_secret": r"(?i:pass|pwd|credential|auth|secret|token|api)", "endpoint": r"://|[0-9]\.[0-9]"}
KINDS = (*BASE, *WEAK)
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "weak_id": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
SCOPE = 200
#: Elements a running sum appends to at once, and code points of a chunk of redacted text.
BLOCK, CHUNK = 256, 1024

SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(sizes: Column) -> Column:
    """Running sums of an array<int>, block by block, so that appending never copies more than a block."""

    def summed(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + x)).alias("sums"))
        return F.aggregate(xs, start, step, lambda acc: acc["sums"])

    def by_blocks(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(BLOCK)), lambda i: i < F.size(xs))
        blocks = F.transform(starts, lambda i: summed(F.slice(xs, i + 1, F.lit(BLOCK))))
        shifted = lambda bs: F.zip_with(bs, summed(F.transform(bs, lambda b: F.element_at(b, -1))), lambda b, upto: F.transform(b, lambda x: x + upto - F.element_at(b, -1)))
        return F.flatten(let(blocks, shifted))

    return let(sizes, by_blocks)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end>> of one kind's matches.

    split() gives the stretches between matches and regexp_extract_all() the matches, so a
    running sum of lengths places each of them.
    """
    pattern = BASE.get(kind) or WEAK[kind]
    group, least = LEAST.get(kind, (0, 1))
    number = KINDS.index(kind)
    between = F.split(text, pattern, -1)
    pieces = F.zip_with(
        F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"))),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda both, value: F.struct(both["gap"].alias("gap"), both["size"].alias("size"), F.length(value).alias("value")),
    )

    def placed(hits: Column) -> Column:
        span = lambda x, end: F.when(x["value"] >= least, F.struct((end - x["size"]).alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.filter(F.zip_with(hits, running(F.transform(hits, lambda x: x["gap"] + x["size"])), span), lambda s: s.isNotNull())

    found = let(F.filter(pieces, lambda x: x["size"].isNotNull()), placed)
    may = (MAY_MATCH.get(kind) or MAY_WEAK[kind])
    return F.when(text.rlike(may), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id"), F.xxhash64(t, F.crc32(t.cast("binary"))).alias("text_key"), t.alias("text"))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that have both complementary parts within `scope` code points, from end to start,
    and overlap no base part (one that does still complements others).

    parts: (doc_id, text_key, start, kind, end), distinct. Each part is dealt to all cells that it
    covers; a weak part looks into its own cells and those beside them, so the join is by equality
    on (document, cell) with a range condition, and a cell holds few parts whatever the document.
    """
    part = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(PART[k]))]), F.col("kind"))
    named = parts.withColumn("part", part)
    cells = lambda more: F.explode(F.expr(f"sequence(start div {scope + 1} - {more}, (end - 1) div {scope + 1} + {more})"))
    weak = named.where(F.col("kind") >= len(BASE)).withColumn("cell", cells(1)).alias("w")
    other = named.withColumn("cell", cells(0)).alias("o")
    near = (F.col("o.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("o.end") <= scope)
    over = (F.col("o.kind") < len(BASE)) & (F.col("o.start") < F.col("w.end")) & (F.col("w.start") < F.col("o.end"))
    differs = F.col("w.part") != F.col("o.part")
    same = F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.text_key") == F.col("o.text_key")) & (F.col("w.cell") == F.col("o.cell"))
    return (
        weak.join(other, same & near & (differs | over))
        .groupBy(*[F.col(f"w.{c}").alias(c) for c in ("doc_id", "text_key", "start", "kind", "end")])
        .agg(F.min(F.when(differs, F.col("o.part"))).alias("one"), F.max(F.when(differs, F.col("o.part"))).alias("another"), F.bool_or(over).alias("hidden"))
        .where("one <> another AND NOT hidden")
        .drop("one", "another", "hidden")
    )


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, base, linked): the base spans and linked weak spans of every row."""
    keyed = _keyed(docs, text)
    base = F.concat(*[spans_of(F.col("text"), k) for k in BASE])
    weak = F.concat(*[spans_of(F.col("text"), k) for k in WEAK])
    found = checkpoint(keyed.select("doc_id", "text_key", base.alias("base"), weak.alias("weak")))
    parts = found.where(F.size("weak") > 0).select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s")).select("doc_id", "text_key", "s.start", "s.kind", "s.end").distinct()
    linked = (
        link(parts, scope)
        .groupBy(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    )
    return found.join(linked, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left").select(
        "doc_id", "text_key", "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked")
    )


def cuts(spans: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_key, cuts): what goes of each chunk of a text, as array<struct<chunk, gone>>.

    spans: (doc_id, text_key, start, kind, end), distinct. Those that overlap are cut as one, under
    the kind that starts first: what reaches beyond all before it goes, and has the name of its
    kind in its place only if it starts beyond them too.
    """
    along = Window.partitionBy("doc_id", "text_key").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("upto", F.coalesce(F.max("end").over(along), F.lit(0))).where(F.col("end") > F.col("upto"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    flat = reached.select("doc_id", "text_key", F.greatest("start", "upto").alias("low"), F.col("end").alias("high"), F.when(F.col("start") >= F.col("upto"), F.element_at(names, F.col("kind") + 1)).otherwise("").alias("name"))
    dealt = flat.withColumn("chunk", F.explode(F.expr(f"sequence(low div {chunk}, (high - 1) div {chunk})")))
    inner = dealt.select("doc_id", "text_key", "chunk", F.greatest(F.col("low") - F.col("chunk") * chunk, F.lit(0)).cast("int").alias("low"), F.least(F.col("high") - F.col("chunk") * chunk, F.lit(chunk)).cast("int").alias("high"), F.when(F.expr(f"low div {chunk} = chunk"), F.col("name")).otherwise("").alias("name"))
    gone = inner.groupBy("doc_id", "text_key", "chunk").agg(F.array_sort(F.collect_list(F.struct("low", "high", "name"))).alias("gone"))
    return gone.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "gone"))).alias("cuts"))


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with each secret's code points replaced by its kind in angle brackets.

    Overlapping spans are cut as one, under the kind that starts first; a column n_chars, if
    there is one, is set to the new length. Other columns stay as they are.
    """
    found = scan(docs, text, scope).where((F.size("base") > 0) | (F.size("linked") > 0))
    spans = found.select("doc_id", "text_key", F.explode(F.concat("base", "linked")).alias("s")).select("doc_id", "text_key", "s.start", "s.kind", "s.end").distinct()
    gone = cuts(spans).select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), F.col("cuts").alias("s_cuts"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("r_row"), F.col("doc_id").alias("r_id"), F.xxhash64(t, F.crc32(t.cast("binary"))).alias("r_key"))
    joined = rows.join(gone, F.col("r_id").eqNullSafe(F.col("s_id")) & (F.col("r_key") == F.col("s_key")), "left")
    whole = F.col("r_row").getField(text)

    def kept(piece: Column, holes: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
        step = lambda acc, h: F.struct(h["high"].alias("at"), F.concat(acc["kept"], F.substring(piece, acc["at"] + 1, h["low"] - acc["at"]), h["name"]).alias("kept"))
        return F.aggregate(holes, start, step, lambda acc: F.concat(acc["kept"], F.substring(piece, acc["at"] + 1, F.length(piece))))

    pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    each = F.transform(pieces, lambda piece, i: let(F.try_element_at(F.col("s_cuts"), i), lambda holes: F.when(holes.isNull(), piece).otherwise(kept(piece, holes))))
    clean = joined.select("r_row", F.when(F.col("s_cuts").isNull(), whole).otherwise(F.array_join(each, "")).alias("r_text"))
    new = {text: F.col("r_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("r_text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[new.get(c, F.col("r_row").getField(c)).alias(c) for c in docs.columns])
