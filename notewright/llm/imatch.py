"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

The lexicon keeps the terms whose document frequency lies in a band. RATES nested random subsets
of it, in REPLICATES independent drawings, each give one hash of a document's distinct terms in
that subset: the exclusive or of 60-bit term hashes, which depends on the sorted set alone. Two
documents are compared, drawing by drawing, in the sparsest subset where either keeps a term;
their likeness is the share of drawings that agree there. Sparse subsets make long documents
tolerant of edits and the full lexicon makes short ones exact.

The lexicon's size does not grow with the corpus: at most (mean distinct terms a document) /
LEAST_SHARE terms reach the band, so it is broadcast while it holds BROADCAST_TERMS or fewer
and joined by shuffle beyond.

Neighbours by id meet in blocks cut at quantiles of (doc_id, md5 of the text), so blocks hold
about as many rows however ids are spread, repeated or missing.

Defined results: a null text counts as empty; a text with no term of the lexicon has the sha256
of the text as fingerprint and a likeness of 1 to an equal fingerprint, else 0; equal texts have
equal fingerprints; a null doc_id sorts after all others; rows of one doc_id sort by the md5 of
their text; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import checkpoint

#: The band: shares of documents a term is in, at least and at most.
LEAST_SHARE, MOST_SHARE = 0.001, 0.5
REPLICATES = 8
#: A 16-bit draw below these keeps a term in subsets of rate 1, 1/4, 1/16, 1/64, 1/256, 1/1024.
RATES = (65536, 16384, 4096, 1024, 256, 64)
BROADCAST_TERMS = 1_000_000
#: Documents a block of neighbouring ids is meant to hold, the most blocks there are (beyond, blocks grow),
#: and keys sampled a block to cut them.
BLOCK_ROWS, MOST_BLOCKS, BLOCK_SAMPLE = 256, 65_536, 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct lower-case terms: stretches of ASCII letters, digits and anything beyond ASCII."""
    return F.filter(F.array_distinct(F.split(F.lower(text), SEPARATORS)), lambda t: t != "")


def _digits(hexed: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(hexed, at, n), 16, 10).cast("long")


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, h, draw_0...): the terms in the band with their hash and random draws."""
    counted = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    band = counted.crossJoin(F.broadcast(total)).where((F.col("df") >= F.greatest(F.lit(2.0), F.col("n") * LEAST_SHARE)) & (F.col("df") <= F.greatest(F.lit(2.0), F.col("n") * MOST_SHARE)))
    drawn = F.md5(F.concat(F.lit("draw:"), F.col("term")).cast("binary"))
    return band.select("term", _digits(F.md5(F.col("term").cast("binary")), 1, 15).alias("h"), *[_digits(drawn, 4 * r + 1, 4).cast("int").alias(f"draw_{r}") for r in range(REPLICATES)])


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def subset_hashes() -> list[Column]:
    """Aggregates over joined terms: one hash a drawing and rate, 0 where no term is kept."""
    return [F.coalesce(F.bit_xor(F.when(F.col(f"draw_{r}") < rate, F.col("h"))), F.lit(0).cast("long")) for r in range(REPLICATES) for rate in RATES]


def likeness(a: Column, b: Column, fingerprints_equal: Column) -> Column:
    """Share of drawings that agree in their sparsest subset where either document keeps a term."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(((x != 0) | (y != 0)).alias("seen"), (x == y).alias("same")))
    drawing = lambda r: F.try_element_at(F.filter(F.slice(pairs, r * len(RATES) + 1, len(RATES)), lambda p: p["seen"]), F.lit(-1))["same"]
    agree = F.filter(F.transform(F.sequence(F.lit(0), F.lit(REPLICATES - 1)), drawing), lambda x: x.isNotNull())
    return F.when(F.size(agree) > 0, F.size(F.filter(agree, lambda x: x)) / F.size(agree)).otherwise(fingerprints_equal.cast("double"))


def _order(doc_id: Column, text_md5: Column) -> Column:
    """Ascending order of ids, those without one first; texts of one id by their md5."""
    return F.struct(doc_id.isNotNull().alias("known"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), text_md5.alias("md5"))


#: A cut point, as _order has it.
KEY = "struct<known:boolean,id:bigint,md5:string>"


def cut_points(keys: DataFrame, n: int) -> list:
    """Keys at which blocks of some BLOCK_ROWS rows start, by quantiles of a sample of bounded size, which Spark takes; the cuts alone come to the driver."""
    blocks = min(MOST_BLOCKS, n // BLOCK_ROWS)
    if blocks < 2:
        return []
    every = max(1, n // (BLOCK_SAMPLE * blocks))
    drawn = keys.where(F.pmod(F.xxhash64("key.id", "key.md5"), F.lit(every)) == 0).select("key").limit(4 * BLOCK_SAMPLE * blocks)
    tiled = drawn.select("key", F.ntile(blocks).over(Window.orderBy("key")).alias("tile")).where("tile > 1")
    found = tiled.groupBy("tile").agg(F.min("key").alias("key")).select(F.to_json("key").alias("key")).distinct().collect()
    return sorted((k["known"], k["id"], k["md5"]) for k in (json.loads(r.key) for r in found))


def block_of(key: Column, cuts: list) -> Column:
    """How many of the cut points are not above key, by bisection over one constant array."""
    if not cuts:
        return F.lit(0)
    named = json.dumps([dict(zip(("known", "id", "md5"), c, strict=True)) for c in cuts])
    points = F.from_json(F.lit(named), f"array<{KEY}>")  # folded to a single literal, however many there are

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        return F.when(acc["low"] >= acc["high"], acc).otherwise(let(middle, lambda i: F.when(F.get(points, i) <= key, F.struct((i + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), i.alias("high")))))

    turns = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), step, lambda acc: acc["low"])


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """(block, rn, extra, doc_id, text, next_text): every document and the next by descending id.

    Neighbouring ids share a block; the head of each block also goes, marked extra, to the end of
    the block before it. Text is shuffled once.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).withColumn("key", _order(F.col("doc_id"), F.col("text_md5")))
    keys = checkpoint(keyed.select("key"))
    cuts = cut_points(keys, keys.count())
    heads = keys.withColumn("block", block_of(F.col("key"), cuts)).groupBy("block").agg(F.max("key").alias("head"))  # MOST_BLOCKS rows at most
    # in descending order a block's head follows the block above it, and the first of all follows the lowest
    one = Window.partitionBy(F.lit(0))
    heads = checkpoint(heads.select("head", F.coalesce(F.lead("block").over(one.orderBy("block")), F.min("block").over(one)).alias("target")))
    tails = keyed.join(F.broadcast(heads), F.col("key") == F.col("head")).groupBy(F.col("target").alias("block"), "key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    placed = keyed.select("doc_id", "text", "text_md5", block_of(F.col("key"), cuts).alias("block"), F.lit(False).alias("extra"))
    joined = placed.unionByName(tails.select("doc_id", "text", F.col("key.md5").alias("text_md5"), "block", F.lit(True).alias("extra")))
    order = Window.partitionBy("block").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("text_md5").desc())
    return joined.select("block", F.row_number().over(order).alias("rn"), "extra", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last third replaced by as much of the start of the following text."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    known = checkpoint(lexicon(docs, text))
    few = known.count() <= BROADCAST_TERMS
    rows = with_next(docs, text).withColumn("edited", F.when(~F.col("extra"), edited(F.col("text"), F.col("next_text"))))
    sha = lambda c: F.unhex(F.sha2(F.col(c), 256))
    # hashes are taken below the explode: beside it they would be taken for every term
    each = lambda kind, t, own: F.struct(F.lit(kind).alias("kind"), F.col(own).alias("own_sha"), F.col(t).alias("t"))
    sized = rows.select("block", "rn", "extra", "doc_id", F.length("text").cast("long").alias("n_chars"), sha("text").alias("text_sha"), sha("edited").alias("edited_sha"), "text", "edited")
    kinds = F.when(F.col("extra"), F.array(each(0, "text", "text_sha"))).otherwise(F.array(each(0, "text", "text_sha"), each(1, "edited", "edited_sha")))
    both = sized.select("block", "rn", "extra", "doc_id", "n_chars", "edited_sha", F.explode(kinds).alias("x"))
    keys = ["block", "rn", "extra", "doc_id", "n_chars", "edited_sha", "kind", "own_sha"]
    spread = both.select(*keys[:6], "x.kind", "x.own_sha", F.posexplode_outer(terms(F.col("x.t"))).alias("pos", "term"))
    joined = spread.join(F.broadcast(known) if few else known, "term", "left").where(F.col("h").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    hashed = joined.groupBy(*keys).agg(*[c.alias(f"s{i}") for i, c in enumerate(subset_hashes())])
    named = hashed.select(*keys, F.array(*[f"s{i}" for i in range(REPLICATES * len(RATES))]).alias("subsets"))
    order = Window.partitionBy("block").orderBy("rn", "kind")
    ahead = named.select(*keys, "subsets", *[F.lead(c, k).over(order).alias(f"{c}_{k}") for c in ("subsets", "own_sha") for k in (1, 2)])
    own = ahead.where("kind = 0 AND NOT extra").select("*", *[_fingerprint(f"subsets{k}", f"own_sha{k}").alias(f"fingerprint{k}") for k in ("", "_1", "_2")])
    near = lambda k: likeness(F.col("subsets"), F.col(f"subsets_{k}"), F.col("fingerprint") == F.col(f"fingerprint_{k}"))
    return own.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), "fingerprint", F.col("fingerprint_1").alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next")
    )


def _fingerprint(subsets: str, own_sha: str) -> Column:
    """The subset hashes as text; without a term of the lexicon, the text's own hash."""
    some = F.exists(subsets, lambda x: x != 0)
    return F.when(some, F.array_join(F.col(subsets).cast("array<string>"), ":")).otherwise(F.lower(F.hex(own_sha)))


def oracle() -> str:
    """The same in SQL, with the next document by one ordering of the table."""
    rates = [(r, rate) for r in range(REPLICATES) for rate in RATES]
    hashes = ",\n    ".join(f"coalesce(bit_xor(CASE WHEN draw[{r + 1}] < {rate} THEN h END), 0) AS s{i}" for i, (r, rate) in enumerate(rates))
    subsets = "[" + ", ".join(f"s{i}" for i in range(len(rates))) + "]"
    n = len(RATES)
    lists = lambda a, b: ", ".join("coalesce(" + ", ".join(f"CASE WHEN {a}[{r * n + s + 1}] <> 0 OR {b}[{r * n + s + 1}] <> 0 THEN ({a}[{r * n + s + 1}] = {b}[{r * n + s + 1}])::INT END" for s in reversed(range(n))) + ")" for r in range(REPLICATES))
    near = lambda a, fa, b, fb: f"CASE WHEN list_count([{lists(a, b)}]) > 0 THEN list_sum([{lists(a, b)}])::DOUBLE / list_count([{lists(a, b)}]) ELSE ({fa} = {fb})::INT::DOUBLE END"
    split = r"list_distinct(list_filter(regexp_split_to_array(lower(t), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS m FROM documents),
nx AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC, m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ed AS (SELECT *, substring(text, 1, length(text) - length(text) // 3) || substring(nxt, 1, length(text) // 3) AS edited FROM nx),
tk AS (SELECT rn, 0 AS kind, text AS t FROM ed UNION ALL SELECT rn, 1, edited FROM ed),
tt AS (SELECT rn, kind, unnest({split}) AS term FROM tk),
lex AS (SELECT term, ('0x' || substring(md5(term), 1, 15))::BIGINT AS h, list_transform(range({REPLICATES}), lambda r: ('0x' || substring(md5('draw:' || term), (4 * r + 1)::INT, 4))::BIGINT) AS draw
  FROM tt WHERE kind = 0 GROUP BY term HAVING count(*) >= greatest(2.0, (SELECT count(*) FROM d) * {LEAST_SHARE}::DOUBLE) AND count(*) <= greatest(2.0, (SELECT count(*) FROM d) * {MOST_SHARE}::DOUBLE)),
hs AS (SELECT rn, kind, {hashes}
  FROM tt JOIN lex USING (term) GROUP BY rn, kind),
fp AS (SELECT tk.rn, tk.kind, coalesce({subsets}, list_transform(range({len(rates)}), lambda x: 0)) AS subsets, CASE WHEN hs.rn IS NOT NULL THEN array_to_string({subsets}, ':') ELSE sha256(t) END AS f FROM tk LEFT JOIN hs USING (rn, kind)),
own AS (SELECT rn, subsets, f, lead(subsets) OVER (ORDER BY rn) AS nsub, lead(f) OVER (ORDER BY rn) AS nf, first_value(subsets) OVER (ORDER BY rn) AS fsub, first_value(f) OVER (ORDER BY rn) AS ff FROM fp WHERE kind = 0),
al AS (SELECT ed.doc_id, ed.text, ed.edited, own.subsets AS a, own.f AS fa, e.subsets AS b, e.f AS fb, coalesce(nsub, fsub) AS c, coalesce(nf, ff) AS fc FROM ed JOIN own USING (rn) JOIN fp e ON e.rn = ed.rn AND e.kind = 1)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, {near('a', 'fa', 'b', 'fb')} AS near_edited, {near('a', 'fa', 'c', 'fc')} AS near_next FROM al"""
