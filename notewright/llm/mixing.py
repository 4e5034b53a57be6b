"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget runs down a tree of path columns (domain, language, source). At each node the
children share their parent's budget by weight, none above its capacity (its tokens times
max_epochs); what a full child cannot take goes to its siblings, so a shortage leaves a subtree
only when the whole subtree is full. All of it is integer arithmetic and adds up exactly.

A leaf then takes whole epochs and, of one further epoch in an order seeded by md5, the longest
prefix of documents that fits what is left. The prefix is found from token sums per hash bucket:
only the one bucket in which it ends is sorted, so no task ever holds a leaf.

Defined results: a null path value is a child of its own; a null or empty text has no tokens and
is taken with every whole epoch and in the prefix wherever it falls before its end; a leaf of no
tokens at all is not taken; rows equal in id and tokens are interchangeable; an empty table
gives an empty one; other columns pass through, except `epoch`, `n_tokens` and names starting
`mix_`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import checkpoint

#: Hash buckets a leaf is summed in: this many hex digits of the md5.
BUCKET_DIGITS = 4
#: Leaves up to which the table of leaves (some 200 bytes each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 20_000
NO_VALUE = "(none)"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _weight(path: Sequence[Column], weights: Mapping[str, int]) -> Column:
    """Weight of a node: looked up by its whole path a/b/c, then by its own name, then 1."""
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, int(v))])
    return F.coalesce(F.element_at(known, F.concat_ws("/", *path)), F.element_at(known, path[-1]), F.lit(1)).cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def share(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """children with `budget`: their parent's `parent_budget` shared by `weight` up to `capacity`.

    In order of capacity per weight, a child is full if its fair part of what those before it
    left is no less than its capacity; the others split the rest in proportion, by differences
    of rounded-down running totals.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("decimal(38,12)") / F.col("weight")), name)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    ranked = children.withColumn("mix_left", F.col("parent_budget") - taken).withColumn("mix_full", _wide(F.col("capacity")) * _wide(F.sum("weight").over(onward)) <= _wide(F.col("weight")) * _wide(F.col("mix_left")))
    siblings = Window.partitionBy(*parent)
    rest = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("mix_full"), F.col("capacity"))).over(siblings), F.lit(0))
    open_weight = F.when(~F.col("mix_full"), F.col("weight"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    upto = ranked.withColumn("mix_rest", rest).withColumn("mix_all", F.sum(open_weight).over(siblings)).withColumn("mix_run", F.sum(open_weight).over(running))
    part = lambda w: F.expr(f"(cast({w} as decimal(19,0)) * cast(mix_rest as decimal(19,0))) div cast(mix_all as decimal(19,0))")
    return upto.withColumn("budget", F.when(F.col("mix_full"), F.col("capacity")).otherwise(part("mix_run") - part("(mix_run - weight)"))).drop("mix_left", "mix_full", "mix_rest", "mix_all", "mix_run")


def budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping[str, int], budget: int | None, max_epochs: int) -> DataFrame:
    """leaves (path..., tokens) with `budget`: what each may take of the tree's budget.

    budget None stands for the tokens there are. A budget above the tree's capacity is cut to it.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
    wanted = F.lit(budget).cast("long") if budget is not None else F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    level = leaves.groupBy(path[0]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    level = share(level.withColumn("parent_budget", F.least(wanted, total)).withColumn("weight", _weight([F.col(path[0])], weights)).withColumn("mix_root", F.lit(0)), ["mix_root"], path[0])
    for depth in range(2, len(path) + 1):
        at, up = list(path[:depth]), list(path[: depth - 1])
        above = level.select(*up, F.col("budget").alias("parent_budget"))
        level = leaves.groupBy(*at).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).join(above, up)
        level = share(level.withColumn("weight", _weight([F.col(c) for c in at], weights)), up, at[-1])
    return level.select(*path, "tokens", "budget")


def mix(
    docs: DataFrame,
    path: Sequence[Column],
    tokens: Column,
    weights: Mapping[str, int],
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    key: str = "doc_id",
) -> DataFrame:
    """The rows of docs that fill the budget, each with `epoch` and `n_tokens`; a row comes once an epoch."""
    if max_epochs < 1 or any(int(w) < 1 for w in weights.values()):
        raise ValueError("max_epochs and weights must be at least 1")
    names = [f"mix_{i}" for i in range(len(path))]
    own = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens") and not c.lower().startswith("mix_")]
    sized = docs.select(*own, *[F.coalesce(p.cast("string"), F.lit(NO_VALUE)).alias(n) for p, n in zip(path, names, strict=True)], tokens.alias("n_tokens"))
    lean = checkpoint(sized.select(F.col(key).alias("mix_key"), *names, "n_tokens"))
    leaves = budgets(lean.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), names, weights, budget, max_epochs)
    plan = leaves.where("tokens > 0").select(*names, F.expr("budget div tokens").alias("mix_full"), F.expr("budget % tokens").alias("mix_part"))

    def ordered(df: DataFrame, k: str) -> DataFrame:
        return df.withColumn("mix_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col("mix_full").cast("string"), F.lit(":"), F.coalesce(F.col(k).cast("string"), F.lit(""))).cast("binary"))).withColumn("mix_bucket", F.substring("mix_hash", 1, BUCKET_DIGITS))

    plan = checkpoint(plan)
    small = plan.count() <= BROADCAST_LEAVES
    held = lambda t: F.broadcast(t) if small else t
    sums = ordered(lean.join(held(plan.where("mix_part > 0")), names), "mix_key").groupBy(*names, "mix_bucket", "mix_part").agg(F.sum("n_tokens").alias("mix_sum"))
    to = Window.partitionBy(*names).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        sums.withColumn("mix_upto", F.sum("mix_sum").over(to))
        .where("mix_upto > mix_part")
        .groupBy(*names)
        .agg(F.min(F.struct("mix_bucket", (F.col("mix_upto") - F.col("mix_sum")).alias("mix_before"))).alias("mix_end"))
        .select(*names, F.col("mix_end.mix_bucket").alias("mix_last"), F.col("mix_end.mix_before").alias("mix_before"))
    )
    plan = checkpoint(plan.join(ends, names, "left"))
    rows = ordered(sized.join(held(plan), names), key)
    partial = F.col("mix_part") > 0
    whole = F.when(F.col("mix_full") > 0, F.sequence(F.lit(0).cast("long"), F.col("mix_full") - 1)).otherwise(F.array().cast("array<bigint>"))
    sure = rows.withColumn("epoch", F.explode(F.concat(whole, F.when(partial & (F.col("mix_bucket") < F.col("mix_last")), F.array("mix_full")).otherwise(F.array().cast("array<bigint>")))))
    along = Window.partitionBy(*names).orderBy("mix_hash", key, "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        rows.where(partial & (F.col("mix_bucket") == F.col("mix_last")))
        .withColumn("mix_run", F.col("mix_before") + F.sum("n_tokens").over(along))
        .where("mix_run <= mix_part")
        .withColumn("epoch", F.col("mix_full"))
    )
    return sure.select(*own, "n_tokens", "epoch").unionByName(edge.select(*own, "n_tokens", "epoch"))


#: The example mixture of the registered query and of the pipeline.
DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'forum' ELSE 'reference' END"
WEIGHTS = {"crawl": 3, "forum": 3, "reference": 4, "en": 4, "de": 2, "fr": 2, "es": 2}
MAX_EPOCHS, SEED = 2, 7


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, [F.expr(DOMAIN_SQL), F.col("lang"), F.col("source")], word_count(F.col("text")), WEIGHTS, None, MAX_EPOCHS, SEED)


def _level_sql(name: str, path: Sequence[str], above: str, known: str) -> str:
    at, up = ", ".join(path), ", ".join(path[:-1])
    ranked = f"PARTITION BY {up or '1'} ORDER BY CAST(capacity AS DOUBLE) / weight, {path[-1]}"
    join = f"JOIN {above} USING ({up})" if up else f"CROSS JOIN {above}"
    return f"""{name}_in AS (SELECT {at}, parent_budget, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity, any_value(CASE {path[-1]} {known} ELSE 1 END)::HUGEINT AS weight
  FROM leaves {join} GROUP BY {at}, parent_budget),
{name}_r AS (SELECT *, capacity * sum(weight) OVER ({ranked} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
    weight * (parent_budget - coalesce(sum(capacity) OVER ({ranked} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM {name}_in),
{name}_o AS (SELECT *, parent_budget - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY {up or '1'}), 0) AS rest,
    sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {up or '1'}) AS open_all, sum(weight) FILTER (NOT is_full) OVER ({ranked} ROWS UNBOUNDED PRECEDING) AS open_run FROM {name}_r),
{name} AS (SELECT {at}, CASE WHEN is_full THEN capacity ELSE (open_run * rest) // open_all - ((open_run - weight) * rest) // open_all END AS parent_budget FROM {name}_o)"""


def oracle() -> str:
    """The mixture in SQL: the same budgets, the prefix by one running sum a leaf."""
    known = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    return f"""WITH docs AS (SELECT doc_id, lang, source, {DOMAIN_SQL} AS d, coalesce(lang, '{NO_VALUE}') AS l, coalesce(source, '{NO_VALUE}') AS s,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT d, l, s, sum(n_tokens)::HUGEINT AS tokens FROM docs GROUP BY d, l, s),
root AS (SELECT least(sum(tokens), sum(tokens) * {MAX_EPOCHS}) AS parent_budget FROM leaves),
{_level_sql('dom', ['d'], 'root', known)},
{_level_sql('lng', ['d', 'l'], 'dom', known)},
{_level_sql('src', ['d', 'l', 's'], 'lng', known)},
leaf AS (SELECT d, l, s, (parent_budget // tokens)::BIGINT AS full_epochs, (parent_budget % tokens)::BIGINT AS part FROM src JOIN leaves USING (d, l, s) WHERE tokens > 0),
runs AS (SELECT docs.*, full_epochs, part, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY md5(concat('{SEED}:', full_epochs, ':', doc_id)), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM docs JOIN leaf USING (d, l, s))
SELECT doc_id, d AS domain, lang, source, n_tokens, epoch FROM (
  SELECT *, unnest(range(full_epochs)) AS epoch FROM runs
  UNION ALL SELECT *, full_epochs AS epoch FROM runs WHERE part > 0 AND upto <= part)"""
