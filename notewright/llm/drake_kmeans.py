"""Centroid clustering of integer vectors, exact, with Drake's adaptive distance bounds.

Every vector keeps an upper bound of the distance to its own centroid, lower bounds of the
distances to its several next nearest centroids, and one bound for all the rest. When centroids
move, the bounds move by as much; a vector whose upper bound is below all of its lower bounds
stays where it is without a distance. Otherwise its own distance is taken anew, then the
distances to the near centroids, and only where the bound of the rest does not exclude the others
are all of them scanned. How many near centroids are kept follows how deep vectors had to look in the round
before. Bounds are floats rounded to the safe side; decisions between centroids are made by exact
integers only, so ties always go to the smaller number.

Each round is one pass: tasks read the vectors and bounds of the round before from the shared
folder, write the new ones, and add a few rows with their sums by cluster; those alone, bounded by the
number of centroids and dimensions, are added up by Spark and brought to the driver.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take
no part; a null id is never a starting centroid but its vector is assigned; repeated rows count
as rows, and of rows with one id the lesser vector starts first; with fewer vectors than centroids all of
them start; an empty table gives an empty one; other columns are ignored. Components of any finite
size are computed exactly; a distance or inertia that a long can't hold is shown as the largest long.
More than MOST_CENTROIDS centroids raise ValueError, as tasks hold all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import dropped, new_place, shared_table

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, "2:"
MOST_CENTROIDS = 1 << 15
#: Sums travel as limbs of so many bits, so that longs hold them.
LIMB_BITS = 32
#: Relative slack of bounds, far above the rounding of a square root and a sum.
SLACK = 1e-9
MOST_LONG = (1 << 63) - 1

_NAMES = ["id", "vector", "cluster", "up", "near", "low", "sum_cluster", "limb", "part", "total", "n", "depth"]


def small_bits(dimensions: int) -> int:
    """Components of fewer bits keep squared distances below 2 ** 61; others are computed by Python's integers."""
    return (60 - max(1, dimensions - 1).bit_length()) // 2 - 1


def _state(kept: DataFrame):
    """Columns of a round: vectors with their bounds, and rows of sums, which have no vector."""
    from pyspark.sql import types as T

    more = T._parse_datatype_string("cluster int, up float, near binary, low binary, sum_cluster int, limb int, part int, total long, n long, depth int")
    return T.StructType([kept.schema["id"], kept.schema["vector"], *more.fields])


def kept_vectors(vectors: DataFrame, vec_id: str, vector: str, dimensions: int) -> DataFrame:
    """(id, vector) of the vectors that take part."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    x = F.col(vector).cast(f"array<{'float' if kind == 'float' else 'double'}>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dimensions)).select(F.col(vec_id).alias("id"), x.alias("vector")).where(~bad)


def integers(row: Sequence[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) of each x, whatever its size."""
    return [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in row]


def starting_centroids(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of least hash of their id."""
    first = kept.where(F.col("id").isNotNull()).orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256), "vector").limit(k)
    return [integers(r.vector) for r in first.collect()]


# --- one batch of vectors ------------------------------------------------------------------------


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def _root_up(squared: int) -> float:
    """No less than the root of an integer of any size."""
    try:
        return float(math.isqrt(squared) + 1) if squared >> 100 else math.sqrt(squared) * (1 + SLACK)
    except OverflowError:
        return math.inf


class Centroids:
    """Centroids of one round, and how far each has moved since the round before."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None):
        self.whole, self.bits = now, small_bits(len(now[0]))
        k, limit = len(now), 1 << self.bits
        small = [all(abs(c) < limit for c in row) for row in now]
        self.small, self.large = np.flatnonzero(small), np.flatnonzero(~np.array(small, bool))
        self.matrix = np.array([now[i] for i in self.small], np.int64).reshape(len(self.small), len(now[0]))
        self.norms = (self.matrix * self.matrix).sum(1)
        self.largest = int(np.abs(self.matrix).max(initial=0))
        moved = [_root_up(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(now, before, strict=True)] if before else [0.0] * k
        self.moved = np.array(moved)

    def distances(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Exact squared distances of small integer vectors; those beyond 2**61 to large centroids count as 2**61."""
        out = np.empty((len(x), len(self.whole)), np.int64)
        if int(np.abs(x).max(initial=0)) * max(1, self.largest) * x.shape[1] < 1 << 52:
            dots = (x.astype(float) @ self.matrix.T.astype(float)).astype(np.int64)  # sums of integers that a double holds
        else:
            dots = x @ self.matrix.T
        out[:, self.small] = norms[:, None] - 2 * dots + self.norms
        for c in self.large:
            row = self.whole[c]
            rough = max(abs(v) for v in row) - (1 << self.bits)
            out[:, c] = 1 << 61 if rough > 1 << 31 else [min(1 << 61, _squared(v, row)) for v in x.tolist()]
        return out

    def own(self, x: np.ndarray, norms: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact squared distance of each small vector to one small centroid."""
        d = x - self.matrix[np.searchsorted(self.small, of)]
        return (d * d).sum(1)


def _squared(x: Sequence[int], y: Sequence[int]) -> int:
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


@dataclass
class Bounds:
    cluster: np.ndarray
    up: np.ndarray
    near: np.ndarray  # rows by b centroids, the nearest first when they were last measured
    low: np.ndarray  # rows by b + 1: a bound for each of them, and one for all others


def scanned(distances: np.ndarray, b: int) -> Bounds:
    """Bounds from all distances: the nearest centroid, the b next ones and the rest."""
    order = np.argsort(distances, axis=1, kind="stable")
    far = np.take_along_axis(distances, order, 1)
    roots = np.sqrt(far.astype(float))
    low = np.full((len(order), b + 1), np.inf, np.float32)
    low[:, : min(b + 1, roots.shape[1] - 1)] = _down(roots[:, 1 : b + 2])
    return Bounds(order[:, 0].astype(np.int32), _up(roots[:, 0]), order[:, 1 : b + 1].astype(np.int16), low)


def reassigned(x: np.ndarray, old: Bounds, centroids: Centroids, b: int) -> tuple[Bounds, int]:
    """Bounds after centroids have moved, and how many near centroids any vector had to look at."""
    have = old.near.shape[1]
    moved = centroids.moved
    with np.errstate(invalid="ignore"):
        up = _up(old.up.astype(float) + moved[old.cluster])
        low = old.low.astype(float)
        low[:, :have] -= moved[old.near]
        low[:, have] -= moved.max(initial=0.0)
    new = Bounds(old.cluster.copy(), up, old.near.copy(), _down(np.maximum(low, 0)))
    norms = (x * x).sum(1)
    open_ = np.flatnonzero(~(new.up < new.low.min(1)))
    tight = open_[np.isin(new.cluster[open_], centroids.small)]
    new.up[tight] = _up(np.sqrt(centroids.own(x[tight], norms[tight], new.cluster[tight]).astype(float)))
    open_ = open_[~(new.up[open_] < new.low[open_].min(1))]
    depth = 0
    if len(open_):
        looked = np.where(new.low[open_, :have] <= new.up[open_, None], np.arange(1, have + 1), 0).max(1, initial=0)
        depth = int(looked.max(initial=0))
        by_near = (new.up[open_] < new.low[open_, have]) & (have > 0)
        some, all_ = open_[by_near], open_[~by_near]
        if len(some):  # the rest is out of reach: only the near ones and the own one compete
            d = centroids.distances(x[some], norms[some])
            ids = np.concatenate([new.cluster[some, None].astype(np.int64), new.near[some].astype(np.int64)], 1)
            ids.sort(1)  # so that the first of equals is the smaller number
            d = np.take_along_axis(d, ids, 1)
            order = np.argsort(d, axis=1, kind="stable")
            ids, roots = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
            new.cluster[some], new.up[some] = ids[:, 0], _up(roots[:, 0])
            new.near[some], new.low[some, :have] = ids[:, 1:], _down(roots[:, 1:])
        if len(all_):
            depth = have
            found = scanned(centroids.distances(x[all_], norms[all_]), have)
            new.cluster[all_], new.up[all_], new.low[all_] = found.cluster, found.up, found.low
            new.near[all_] = found.near
    if b < have:  # keep the nearer ones; what is dropped joins the rest
        order = np.argsort(new.low[:, :have], axis=1, kind="stable")
        low = np.take_along_axis(new.low[:, :have], order, 1)
        rest = np.minimum(low[:, b:].min(1), new.low[:, have])
        new = Bounds(new.cluster, new.up, np.take_along_axis(new.near, order, 1)[:, :b], np.concatenate([low[:, :b], rest[:, None]], 1))
    return new, depth


def limbs(value: int) -> list[int]:
    """value in signed digits of base 2 ** LIMB_BITS, the last one with the sign."""
    out = []
    while not -(1 << LIMB_BITS) < value < 1 << LIMB_BITS:
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


class Sums:
    """Exact sums by cluster of a task's rows, as rows of limbs."""

    def __init__(self, k: int, parts: int):
        self.total, self.n, self.more, self.depth = np.zeros((k, parts), np.int64), np.zeros(k, np.int64), {}, 0

    def add(self, clusters: np.ndarray, values: np.ndarray) -> None:
        """Rows of small integers."""
        for c in np.unique(clusters):
            self.total[c] += values[clusters == c].sum(0)
        self.n += np.bincount(clusters, minlength=len(self.n))

    def add_large(self, cluster: int, values: Sequence[int]) -> None:
        for part, value in enumerate(values):
            for i, digit in enumerate(limbs(value)):
                self.more[cluster, i, part] = self.more.get((cluster, i, part), 0) + digit
        self.n[cluster] += 1

    def rows(self):
        """(cluster, limb, part, total, n); n counts with the first part alone."""
        for (c, part), total in np.ndenumerate(self.total):
            if self.n[c]:
                yield int(c), 0, int(part), int(total), int(self.n[c]) if part == 0 else 0
        for (c, i, part), total in self.more.items():
            yield c, i, part, total, 0


def _sum_batch(sums: Sums, kinds):
    import pyarrow as pa

    rows = list(sums.rows())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    m = len(rows)
    arrays = [pa.nulls(m, kind) for kind in kinds]
    arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([sums.depth] * m, pa.int32())], names=_NAMES)


def _vectors(batch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Components as doubles, rows by dimensions, and the scaled integers as doubles."""
    column = batch.column(batch.schema.get_field_index("vector"))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions).astype(float)
    with np.errstate(over="ignore"):
        return x, np.floor(x * SCALE)


def one_round(vectors: DataFrame, centroids: Centroids, dimensions: int, b: int, last: bool = False) -> DataFrame:
    """The rows of _state after assigning every vector; sums are of its components or, in the last round, of exact squared distances."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    k, schema = len(centroids.whole), _state(vectors)
    vector_kind = to_arrow_type(schema["vector"].dataType)
    kinds = [to_arrow_type(schema["id"].dataType), vector_kind, pa.int32(), pa.float32(), pa.binary(), pa.binary()]

    def run(batches):
        sums = Sums(k, 1 if last else dimensions)
        for batch in batches:
            if not batch.num_rows:
                continue
            plain, scaled = _vectors(batch, dimensions)
            fits = (np.abs(scaled) < 1 << centroids.bits).all(1) if len(centroids.small) else np.zeros(len(scaled), bool)
            small, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
            x = scaled[small].astype(np.int64)
            known = "low" in batch.schema.names
            have = min(b, k - 1)
            if known and len(small):
                field = lambda name: batch.column(batch.schema.get_field_index(name)).take(pa.array(small))
                low = np.frombuffer(b"".join(field("low").to_pylist()), np.float32).reshape(len(small), -1)
                near = np.frombuffer(b"".join(field("near").to_pylist()), np.int16).reshape(len(small), low.shape[1] - 1)
                old = Bounds(field("cluster").to_numpy(), field("up").to_numpy(zero_copy_only=False), near, low)
                found, depth = reassigned(x, old, centroids, min(have, near.shape[1]))
                sums.depth = max(sums.depth, depth)
            else:
                found = scanned(centroids.distances(x, (x * x).sum(1)), have) if len(small) else Bounds(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, have), np.int16), np.zeros((0, have + 1), np.float32))
            width = found.near.shape[1]
            cluster, up = np.zeros(len(scaled), np.int32), np.full(len(scaled), np.inf, np.float32)
            near, low = np.zeros((len(scaled), width), np.int16), np.zeros((len(scaled), width + 1), np.float32)
            cluster[small], up[small], near[small], low[small] = found.cluster, found.up, found.near, found.low
            distance = [0] * len(scaled)
            if last and len(small):
                exact = np.take_along_axis(centroids.distances(x, (x * x).sum(1)), found.cluster[:, None].astype(np.int64), 1)[:, 0]
                for i, d in zip(small.tolist(), exact.tolist(), strict=True):
                    distance[i] = d if d < 1 << 61 else _squared(integers(plain[i].tolist()), centroids.whole[cluster[i]])
            elif len(small):
                sums.add(found.cluster, x)
            for i in rest.tolist():  # components beyond small integers: every distance, by Python's integers
                whole = integers(plain[i].tolist())
                distance[i], cluster[i] = min((_squared(whole, c), j) for j, c in enumerate(centroids.whole))
                if not last:
                    sums.add_large(int(cluster[i]), whole)
            if last:
                for c, d in zip(cluster.tolist(), distance, strict=True):
                    sums.add_large(c, [d])
            m = len(scaled)
            null = lambda kind: pa.nulls(m, kind)
            blob = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            vector = null(vector_kind) if last else batch.column(batch.schema.get_field_index("vector"))
            total = pa.array([min(d, MOST_LONG) for d in distance], pa.int64()) if last else null(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), vector, pa.array(cluster), pa.array(up), null(pa.binary()) if last else blob(near), null(pa.binary()) if last else blob(low), null(pa.int32()), null(pa.int32()), null(pa.int32()), total, null(pa.int64()), null(pa.int32())], names=_NAMES
            )
        yield _sum_batch(sums, kinds)

    return vectors.mapInArrow(run, schema)


def gathered(state: DataFrame) -> tuple[dict[int, dict[int, int]], dict[int, int], int]:
    """Exact sums by cluster and part, rows by cluster, and the depth any vector looked to."""
    wide = F.col("total").cast("decimal(38,0)")
    rows = state.where(F.col("sum_cluster").isNotNull()).groupBy("sum_cluster", "limb", "part").agg(F.sum(wide).alias("total"), F.sum("n").alias("n"), F.max("depth").alias("depth"))
    sums: dict[int, dict[int, int]] = {}
    sizes: dict[int, int] = {}
    depth = 0
    for r in rows.collect():  # centroids by dimensions by limbs
        parts = sums.setdefault(r.sum_cluster, {})
        parts[r.part] = parts.get(r.part, 0) + (int(r.total) << (LIMB_BITS * r.limb))
        sizes[r.sum_cluster] = sizes.get(r.sum_cluster, 0) + int(r.n)
        depth = max(depth, r.depth)
    return sums, sizes, depth


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) after `rounds` moves of the centroids."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MOST_CENTROIDS}")
    kept = kept_vectors(vectors, vec_id, vector, dimensions)
    spark = vectors.sparkSession
    now = starting_centroids(kept, k, seed)
    result = f"{vec_id} {vectors.schema[vec_id].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not now:
        return spark.createDataFrame([], result)
    before, current, b, old = None, kept, max(1, len(now) // 4), None
    for step in range(rounds + 1):
        last, place = step == rounds, new_place(spark, "clusters")
        state = shared_table(one_round(current, Centroids(now, before), dimensions, b, last), "clusters", place)
        if old:
            dropped(spark, old)
        old = place
        sums, sizes, depth = gathered(state)
        if not last:
            before, now = now, [[sums[c][i] // sizes[c] for i in range(dimensions)] if sizes.get(c) else row for c, row in enumerate(now)]
            if step:
                b = min(b, max(1, len(now) // 8, depth))
            current = state.where(F.col("sum_cluster").isNull()).select("id", "vector", "cluster", "up", "near", "low")
    inertia = {c: parts[0] for c, parts in sums.items()}
    shown = [(c, min(inertia.get(c, 0), MOST_LONG), min(sum(inertia.values()), MOST_LONG), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(now)]
    totals = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.where(F.col("sum_cluster").isNull()).select(F.col("id").alias(vec_id), "cluster", F.col("total").alias("distance"))
    return found.join(F.broadcast(totals), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """SQL of the same clustering without bounds: every distance in every round."""
    sql = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{SEED}' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS m FROM v, c{i} c GROUP BY r)"""
        if i < rounds:
            sql += f""",
s{i} AS (SELECT m.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {DIMENSIONS + 1}) t(i) GROUP BY ALL),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c))"""
    return sql + f"""
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(list_aggregate(c.x, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.m.c"""
