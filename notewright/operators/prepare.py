"""Corpus preparation: union, dedupe, exact samples, splits by group, training pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.prompts import prompt

#: Hex digits of a hash that name its bucket: 65,536 buckets, each ranked by a task of its own.
BUCKET_DIGITS = 4


def union(*frames: DataFrame) -> DataFrame:
    """All rows; columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row, by the order columns, of each value of key; nulls are one value.

    Rows are grouped by a digest of key and reduced before the shuffle, so a value with many
    copies brings one row a task. The order columns must tell rows apart.
    """
    rest = F.struct(*[F.col(c) for c in df.columns])
    digest = F.unhex(F.sha2(F.col(key).cast("string"), 256))
    return df.groupBy(digest.alias("_digest")).agg(F.min_by(rest, F.struct(*order)).alias("_row")).select("_row.*")


def dedupe_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One of each set of rows that agree on columns."""
    return df.dropDuplicates(list(columns or df.columns))


def _hashed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def ranked(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with `_rank`: the place of each row, from 1, in the order of its seeded md5, then key.

    Rows are ranked within hash buckets; bucket sizes, at most 16 ** BUCKET_DIGITS rows, give
    each bucket its base. Nothing is sorted as a whole.
    """
    h = df.withColumn("_hash", _hashed(F.col(key), seed)).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    sizes = h.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    return h.withColumn("_within", within).join(F.broadcast(bases), "_bucket").withColumn("_rank", F.col("_base") + F.col("_within")).drop("_hash", "_bucket", "_within", "_base")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if fewer), the same ones for a seed whatever the partitioning: a bounded top-k."""
    h = df.withColumn("_hash", _hashed(F.col(key), seed))
    return h.orderBy("_hash", key).limit(n).drop("_hash")


def group_split(df: DataFrame, group: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with `split`: train for floor(share * groups) whole groups, eval for the others.

    Rows of a null group go to eval, as they belong to none.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    total = groups.agg(F.count(F.lit(1)).alias("_total"))  # one row
    placed = ranked(groups, group, seed).crossJoin(F.broadcast(total))
    train = placed.where(F.col("_rank") <= F.floor(F.lit(share).cast("double") * F.col("_total"))).select(group, F.lit("train").alias("split"))
    return df.join(train, group, "left").select(*df.columns, F.coalesce("split", F.lit("eval")).alias("split"))


def split_report(split: DataFrame, group: str) -> DataFrame:
    """Per split its rows and groups."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"))


def split_overlap(split: DataFrame, group: str) -> DataFrame:
    """Groups that are in both splits; a right split has none."""
    side = lambda s: split.where(F.col("split") == s).select(group)
    return side("train").intersect(side("eval"))


def training_pairs(df: DataFrame, date: Column, text: Column, output: Column) -> DataFrame:
    """(input, output): the training prompt and what a model should answer."""
    return df.select(prompt("training", date, text).alias("input"), output.alias("output"))


def with_defaults(df: DataFrame, columns: dict[str, tuple[str, object]], unless: str | None = None) -> DataFrame:
    """df with the columns it lacks, at their starting values.

    With `unless`, none is added if that column is there, and all are set if it isn't.
    """
    if unless is not None:
        wanted = {} if unless in df.columns else columns
    else:
        wanted = {c: v for c, v in columns.items() if c not in df.columns}
    return df.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in wanted.items()}) if wanted else df


def unique_only(df: DataFrame, flag: str = "is_unique") -> DataFrame:
    return df.where(F.col(flag))


def text_of(df: DataFrame, key: str, value: object, text: str) -> str:
    """The text of the first row whose key reads value; raises KeyError if there is none.

    Whole numbers and texts are also compared in the key's own type, which a scan of a keyed table can use.
    """
    reads = F.col(key).cast("string") == str(value)
    if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "string"):
        reads = (F.col(key) == F.lit(str(value)).try_cast(df.schema[key].dataType)) & reads
    found = df.where(reads).select(text).head(1)
    if not found:
        raise KeyError(value)
    return found[0][0]
