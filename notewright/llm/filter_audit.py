"""Filter interaction audit: what every order of a set of filters keeps and removes, part by part.

Each document's failures become a mask, one bit a filter. Documents are counted once by (part,
mask); a subset-zeta transform turns a part's counts by mask into survivors of every subset of
filters (those whose mask lies outside the subset), one pass a filter. A step of an order is the
difference between the survivors of two neighbouring subsets, so no order is ever run over
documents; the same holds for counts of labelled documents.

A filter may be a condition on a row, or "repeated": the text equals that of a row of a smaller
id. Texts are compared by their sha-256, copies are reduced to the least id before the shuffle.

Defined results: a null text counts as empty; a null part is the empty string; a row without an id
is never a repeat and no other repeats it; rows of one id and text do not repeat each other; a
label counts where any label row of the id has it, and never for a row without an id; a null condition does not fail;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks the filter that fails texts equal to one of a smaller id.
REPEATED = "repeated"
#: Rows without an id are dealt to so many keys of the join with labels.
SPREAD = 1024


def failures(text: Column, conditions: Mapping[str, Column | str]) -> Column:
    """The mask of the conditions that hold, bit i for the i-th; the repeated one is left open."""
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values()) if not isinstance(c, str)]
    total = F.lit(0)
    for b in bits:
        total = total + b
    return total.cast("int")


def masks(docs: DataFrame, conditions: Mapping[str, Column | str], part: Column, labels: Mapping[str, DataFrame], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, one column a label): documents by what they fail; labels are tables of marked ids."""
    names = [f"label_{i}" for i in range(len(labels))]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("audit_id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        failures(whole, conditions).alias("mask"),
        F.sha2(whole.cast("binary"), 256).alias("audit_text"),
        F.when(F.col(doc_id).isNull(), F.pmod(F.xxhash64(whole), F.lit(SPREAD))).otherwise(F.lit(0)).alias("audit_spread"),
    )
    rows = rows.groupBy("audit_id", "audit_spread", "part", "mask", "audit_text").agg(F.count(F.lit(1)).alias("n"))
    marked = None
    for name, ids in zip(names, labels.values(), strict=True):
        own = ids.select(F.col(doc_id).alias("audit_id")).where("audit_id IS NOT NULL").select("audit_id", *[F.lit(int(x == name)).alias(x) for x in names])
        marked = own if marked is None else marked.unionByName(own)
    if marked is not None:
        marked = marked.groupBy("audit_id").agg(*[F.max(x).alias(x) for x in names]).withColumn("audit_spread", F.lit(0).cast("long"))
        rows = rows.join(marked, ["audit_id", "audit_spread"], "left").na.fill(0, names)
    repeats = [i for i, c in enumerate(conditions.values()) if isinstance(c, str)]
    key = ["part", "mask", *names]
    if repeats:
        copies = rows.groupBy("audit_text", *key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("audit_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("nameless"), F.min(F.when(F.col("audit_id").isNotNull(), F.struct("audit_id", "n"))).alias("first"))
        first = F.col("first.audit_id") == F.min("first.audit_id").over(Window.partitionBy("audit_text"))
        copies = copies.withColumn("alone", F.col("nameless") + F.when(first, F.col("first.n")).otherwise(F.lit(0)))
        bit = sum(1 << i for i in repeats)
        rows = copies.select(*[c for c in key if c != "mask"], F.explode(F.array(F.struct(F.col("mask"), F.col("alone").alias("n")), F.struct((F.col("mask") + F.lit(bit)).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))).alias("x")).select(*[c for c in key if c != "mask"], "x.mask", "x.n").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(x)).alias(x) for x in names])


def zeta(counts: DataFrame, k: int, values: Sequence[str]) -> DataFrame:
    """(part, one array a value): entry s counts the documents that pass every filter of subset s."""
    size, whole = 1 << k, (1 << k) - 1
    total = lambda v, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(v))), F.lit(0))
    # entry s starts with the documents that fail exactly the filters outside s
    table = counts.groupBy("part").agg(*[F.array(*[total(v, whole ^ s) for s in range(size)]).alias(v) for v in values])
    for bit in (1 << i for i in range(k)):  # drop filter after filter from the subsets: who passes more passes less
        more = lambda v, b=bit: F.transform(F.col(v), lambda x, s: x + F.when(s.bitwiseAND(F.lit(b)) == 0, F.element_at(F.col(v), s.bitwiseOR(F.lit(b)) + 1)).otherwise(F.lit(0)))
        table = table.select("part", *[more(v).alias(v) for v in values])
    return table


def steps(survivors: DataFrame, names: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Every step of every order of the filters, a row each, with the counts of the part."""
    k = len(names)
    orders = F.explode(F.array(*[F.struct(F.lit("".join(names[i] for i in p)).alias("filter_order"), F.array(*[F.lit(1 << i) for i in p]).alias("bits")) for p in permutations(range(k))]))
    each = survivors.select("*", orders.alias("o")).select("*", "o.*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    union = lambda n: F.aggregate(F.slice("bits", F.lit(1), n), F.lit(0), lambda a, b: a.bitwiseOR(b))
    each = each.select("*", union(F.col("step") - 1).alias("before"), union(F.col("step")).alias("after"), F.element_at("bits", F.col("step")).alias("bit"))
    at = lambda v, s: F.element_at(v, s + 1)
    removed = at("n", F.col("before")) - at("n", F.col("after"))
    failing = at("n", F.lit(0)) - at("n", F.col("bit"))
    others = F.lit((1 << k) - 1).bitwiseXOR(F.col("bit"))
    found = each.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        (at("n", others) - at("n", F.lit((1 << k) - 1))).alias("unique_fails"),
        *[(at(x, F.col("before")) - at(x, F.col("after"))).alias(f"{name}_lost") for x, name in ((f"label_{i}", name) for i, name in enumerate(labels))],
        "bit",
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, conditions: Mapping[str, Column | str], part: Column, labels: Mapping[str, DataFrame] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole audit: filters by one-letter names, labels by name as tables with the marked ids."""
    labels = labels or {}
    values = ["n", *[f"label_{i}" for i in range(len(labels))]]
    survivors = zeta(masks(docs, conditions, part, labels, doc_id, text), len(conditions), values)
    return steps(survivors, list(conditions), list(labels))


def corpus_filters(text: Column) -> dict[str, Column | str]:
    """The five filters of the corpus audit: few words, few distinct words, many capitals, symbols, repeats."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    many = F.size(words)
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return {
        "A": many < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * many,
        "C": 100 * capitals > 3 * F.length(whole),
        "D": whole.rlike("[#$%&*|]"),
        "E": REPEATED,
    }


def oracle() -> str:
    """SQL of the audit over documents and labels: every order is run step by step over the documents."""
    return r"""
WITH RECURSIVE d AS (SELECT coalesce(lang, '') AS part, coalesce(text, '') AS t, doc_id FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[:step - 1] AS earlier, filter_order[:step] AS upto FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT s.*, p.*, length(translate(fails, earlier, '')) < length(fails) AS gone, contains(fails, filter) AS failing FROM s, p),
y AS (SELECT part, filter_order, step, filter,
  sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed, sum(n) FILTER (gone AND failing) AS redundant,
  sum(n) FILTER (fails = filter) AS unique_fails, sum(good) FILTER (NOT gone AND failing) AS good_lost, sum(toxic) FILTER (NOT gone AND failing) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM y"""
