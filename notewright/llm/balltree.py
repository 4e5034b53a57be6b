"""Exact top-k inner-product search: branch and bound over a ball tree per shard.

A ball tree over a bounded sample cuts space into cells; every vector goes to its cell and,
where a cell holds many, to one of several shards of it. Each shard's ball bounds the scores in
it. A query first searches the shard of the largest bound, then a few more, then all that are
left, each time only shards whose bound reaches its kth score so far; so the kth score is shared
between shards and rises from round to round. Within a shard, nodes of a ball tree are visited
best first by the upper bound <q, centre> + |q| * radius and left once it is below that score.

Pairs of (query, shard) are dealt in groups of one shard and at most BLOCK_QUERIES queries, so a
task holds one shard and one block; a query brings back at most k rows a shard.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no
part, neither as queries nor as candidates; the same goes for a null id; vectors of another
length than the query's are not its candidates; ties go to the smaller id; repeated rows count
as rows; with fewer than k candidates all are returned; an empty table gives an empty one. Scores
are exact whatever the size of the components, between shards too: they travel as bytes that sort
like the integers; one that a long can't hold is shown as the nearest that it can, at the very end.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import checkpoint

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8_192, 8_192, 128
#: Bound of the sample that cuts space, and of the cells it is cut into (over all vector lengths).
SAMPLE_ROWS, MOST_CELLS = 32_768, 1_024
#: Shards a query searches in the first rounds; the last round takes all others that its kth score leaves.
ROUNDS = (1, 4)
RESULT = "query_id long, query_row long, vec_id long, exact binary"
LONG = 2**63 - 1


class BallTree:
    """Points split at the median along the line between two far points, down to leaf_rows."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left, right (-1: leaf)
        self.planes: list[tuple[np.ndarray, float] | None] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._points = points
        self._grow(0, len(points), leaf_rows)
        self.points = points[self.order]
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)
        self.leaves = [i for i, n in enumerate(self.nodes) if n[2] < 0]

    def _grow(self, start: int, stop: int, leaf_rows: int) -> int:
        rows = self._points[self.order[start:stop]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        here = len(self.nodes)
        self.nodes.append((start, stop, -1, -1))
        self.planes.append(None)
        self.centres.append(centre)
        self.radii.append(float(away.max()))
        if stop - start > leaf_rows and self.radii[here] > 0:
            far = rows[int(away.argmax())]
            other = rows[int(((rows - far) ** 2).sum(axis=1).argmax())]
            along, half = rows @ (far - other), (stop - start) // 2
            place = np.argpartition(along, half)
            self.planes[here] = (far - other, float(along[place[half]]))
            self.order[start:stop] = self.order[start:stop][place]
            left = self._grow(start, start + half, leaf_rows)
            right = self._grow(start + half, stop, leaf_rows)
            self.nodes[here] = (start, stop, left, right)
        return here

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The leaf, numbered from 0, on whose side of all planes each point lies."""
        out, number, todo = np.zeros(len(points), np.int64), {n: i for i, n in enumerate(self.leaves)}, [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            plane = self.planes[node]
            if plane is None:
                out[rows] = number[node]
            elif len(rows):
                right = points[rows] @ plane[0] >= plane[1]
                todo += [(self.nodes[node][2], rows[~right]), (self.nodes[node][3], rows[right])]
        return out


class Shard:
    """A ball tree over the integer vectors of one shard, with exact scores.

    Where double precision can't hold the scores, they are reckoned in whole numbers of any size
    and only the bounds, over vectors scaled to at most 1, in doubles.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.scale = _scale(vectors)
        self.tree = BallTree(vectors / self.scale)
        self.vectors, self.ids, self.rows = vectors[self.tree.order], ids[self.tree.order], rows[self.tree.order]
        self.far = float(np.sqrt((self.tree.centre**2).sum(axis=1)).max() + self.tree.radius.max())

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) at or above floor, without the query's own row."""
        tree, scale = self.tree, _scale(query)
        exact = float(np.abs(query).max()) * self.scale * (1.0 if self.scale > 1 else float(np.abs(self.vectors).max())) * len(query) >= 2**53
        whole = np.array(list(map(_whole, query.tolist())), object) if exact else query
        if floor is not None and not exact:  # scores here are below 2**53, whatever other shards hold
            floor = max(-(1 << 1000), min(1 << 1000, floor))
        unit = scale * self.scale
        near = query / scale
        norm = float(np.sqrt(near @ near))
        bound = tree.centre @ near + norm * tree.radius + 1e-9 * norm * self.far  # rounding of bounds; scores are exact
        reach = -np.inf if floor is None else float(floor / unit) if unit == 1.0 else _ratio(floor, scale, self.scale)
        best: list[tuple[int, int]] = []
        queue = [(-float(bound[0]), 0)]
        while queue:
            at, node = heapq.heappop(queue)
            if -at < reach:
                break
            start, stop, left, right = tree.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (-float(bound[left]), left))
                heapq.heappush(queue, (-float(bound[right]), right))
                continue
            scores = _exact(self.vectors[start:stop], whole) if exact else self.vectors[start:stop] @ query
            take = np.flatnonzero((scores >= floor) if floor is not None else np.ones(stop - start, bool))
            take = take[self.rows[start:stop][take] != own]
            if len(take) > k and not exact:  # all that could be among the k, ties included
                kth = np.partition(scores[take], len(take) - k)[len(take) - k]
                take = take[scores[take] >= kth]
                if len(take) > k:
                    take = take[np.lexsort((self.ids[start:stop][take], -scores[take]))[:k]]
            for j in take:
                item = (int(scores[j]), -int(self.ids[start + j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
                reach = float(floor) if unit == 1.0 else _ratio(floor, scale, self.scale)
        return best


def _scale(x: np.ndarray) -> float:
    """1 where double precision is roomy, else a power of two not below any component."""
    most = float(np.abs(x).max()) if x.size else 0.0
    return 1.0 if most < 2.0**40 else 2.0 ** int(np.ceil(np.log2(most)))


def _ratio(number: int, *scales: float) -> float:
    """number over a product of powers of two, which may each be beyond what a double holds together."""
    shift = sum(int(np.log2(s)) for s in scales)
    top = max(0, abs(number).bit_length() - 60)
    return float(np.ldexp(float(number >> top), top - shift)) - 1e-15


def _whole(x: float) -> int:
    return int(x)


def ordered_bytes(n: int) -> bytes:
    """An integer of any size as bytes that sort like it."""
    size = (abs(n).bit_length() + 7) // 8
    raw = abs(n).to_bytes(size)
    return b"\x01" + size.to_bytes(2) + raw if n >= 0 else b"\x00" + (0xFFFF - size).to_bytes(2) + bytes(255 - b for b in raw)


def from_ordered(key: bytes) -> int:
    """The integer of ordered_bytes."""
    return int.from_bytes(key[3:]) if key[0] else -int.from_bytes(bytes(255 - b for b in key[3:]))


def _exact(vectors: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in vectors.tolist()], object)


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def quantised(column, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of an Arrow column of vectors of one length, as whole doubles; beyond 2**1015 as the largest."""
    flat = np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), dtype=np.float64)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(flat * scale)).reshape(len(column), -1)


@dataclass(frozen=True)
class Cells:
    """For each length of vectors, the tree that cuts their space; `base` numbers its first cell."""

    trees: Mapping[int, tuple[int, BallTree]]


def cells(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> Cells:
    """Cells of about shard_rows vectors, cut from a sample of at most SAMPLE_ROWS of (dim, v, row_id).

    Lengths beyond MOST_CELLS different ones share a single cell each, as do the rarest of fewer.
    """
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(MOST_CELLS).collect()}
    all_, base, trees = sum(counts.values()), 0, {}
    if not all_:
        return Cells({})
    every = max(1, all_ // (SAMPLE_ROWS // 2))
    drawn = vectors.where(F.col("dim").isin([d for d, n in counts.items() if n > shard_rows]) & (F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(every)) == 0))
    found = drawn.select("dim", "v").limit(SAMPLE_ROWS).toArrow()
    dims = found.column("dim").to_numpy()
    for d, n in counts.items():
        mine = found.filter(dims == d) if len(dims) else found
        want = max(1, min(-(-n // shard_rows), MOST_CELLS * n // all_))
        if mine.num_rows < 2 * want:
            continue
        sample = quantised(mine.column("v"))
        if float(np.abs(sample).max()) < 2.0**500:
            trees[d] = (base, BallTree(sample, -(-mine.num_rows // want)))
            base += len(trees[d][1].leaves)
    return Cells(trees)


def _searcher(k: int):
    def run(key: tuple, left, right):
        import pyarrow as pa

        out: list[tuple[int, int, int, bytes]] = []
        if left.num_rows and right.num_rows:
            queries = quantised(left.column("q"))
            shard = Shard(quantised(right.column("v")), right.column("vec_id").to_numpy(), right.column("row_id").to_numpy())
            for i, (query_id, row, floor) in enumerate(zip(*[left.column(c).to_pylist() for c in ("query_id", "query_row", "floor")], strict=True)):
                out += [(query_id, row, -negative, ordered_bytes(int(score))) for score, negative in shard.search(queries[i], row, k, None if floor is None else from_ordered(floor))]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.binary())], names=["query_id", "query_row", "vec_id", "exact"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, its own row apart."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("v"), is_query.alias("is_query"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("row_id", F.xxhash64("vec_id", "v"))
    # equal rows share a row_id: the query's own is told apart by a number among them
    twin = F.row_number().over(Window.partitionBy("vec_id", "row_id").orderBy(F.lit(0)))
    rows = rows.withColumn("row_id", F.xxhash64("row_id", twin))
    cut = cells(rows, shard_rows)

    def place(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, away = np.full(len(dims), -1, np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                if d in cut.trees:
                    base, tree = cut.trees[d]
                    mine = np.flatnonzero(dims == d)
                    points = quantised(batch.column(2).take(pa.array(mine)))
                    leaf = tree.cells(points)
                    cell[mine] = base + leaf
                    with np.errstate(over="ignore"):
                        away[mine] = np.sqrt(((points - tree.centre[np.array(tree.leaves)[leaf]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(cell), pc.if_else(pa.array(np.isfinite(away)), pa.array(away), pa.scalar(1e308))], names=["vec_id", "dim", "v", "row_id", "is_query", "cell", "away"])

    placed = checkpoint(rows.select("vec_id", "dim", "v", "row_id", "is_query").mapInArrow(place, "vec_id long, dim int, v array<double>, row_id long, is_query boolean, cell long, away double"))
    # a cell is one ball; its rows are dealt to as many shards as they fill, so that copies of one vector don't stay together
    sized = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    known = {(r.dim, r.cell): (r.radius, -(-r.n // shard_rows)) for r in sized.where("cell >= 0").collect()}  # at most MOST_CELLS rows
    shard_of = sized.select(F.col("dim").alias("c_dim"), F.col("cell").alias("c_cell"), F.ceil(F.col("n") / shard_rows).cast("int").alias("parts"))
    points = placed.join(F.broadcast(shard_of) if len(known) < MOST_CELLS else shard_of, (F.col("dim") == F.col("c_dim")) & (F.col("cell") == F.col("c_cell")))
    points = points.select(F.col("dim").alias("p_dim"), F.col("cell").alias("p_cell"), F.pmod(F.xxhash64("row_id", F.lit(1)), F.col("parts")).cast("int").alias("p_part"), "vec_id", "row_id", "v")
    rest = shard_of.where("c_cell < 0").select(F.col("c_dim").alias("dim"), "parts")  # lengths without cells: one bound-less cell each
    asked = placed.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("row_id").alias("query_row"), F.col("v").alias("q"), "dim")

    def targets(done: int, stop: int | None):
        """For mapInArrow: (query..., cell, part) of the shards a query may need, those of the largest bound first, from the done-th to before the stop-th."""
        balls = {}
        for d, (base, t) in cut.trees.items():
            own = [known.get((d, base + j), (0.0, 0)) for j in range(len(t.leaves))]
            centre = np.array([t.centres[i] for i in t.leaves])
            balls[d] = base, centre, np.sqrt((centre**2).sum(axis=1)), np.array([r for r, _ in own]), [n for _, n in own]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                dims, floors = batch.column(3).to_numpy(), [None if f is None else from_ordered(f) for f in batch.column(4).to_pylist()]
                row, cell, part = [], [], []
                for i, d in enumerate(dims.tolist()):
                    if d not in balls:
                        continue
                    base, centre, norms, far, parts = balls[d]
                    q = quantised(batch.column(2).slice(i, 1))[0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        norm = float(np.sqrt(q @ q))
                        bound = centre @ q + norm * far
                        bound = np.nan_to_num(bound + 1e-9 * norm * (norms + far), nan=np.inf).tolist()
                    order = (j for j in np.argsort(-np.array(bound), kind="stable").tolist() if floors[i] is None or bound[j] >= floors[i])
                    for c, p in islice(((base + j, p) for j in order for p in range(parts[j])), done, stop):
                        row.append(i)
                        cell.append(c)
                        part.append(p)
                taken = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[taken.column(j) for j in range(5)], pa.array(cell, pa.int64()), pa.array(part, pa.int32())], names=["query_id", "query_row", "q", "dim", "floor", "cell", "part"])

        return run

    TARGETS = "query_id long, query_row long, q array<double>, dim int, floor binary, cell long, part int"
    keys = ["dim", "cell", "part"]

    def search(pairs: DataFrame) -> DataFrame:
        """Top k of each (query, shard) pair."""
        blocks = pairs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
        left = pairs.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("query_row", F.lit(2)), F.col("blocks")).cast("int")).drop("blocks")
        spread = points.join(blocks.select(*[F.col(c).alias(f"p_{c}") for c in keys], F.col("blocks").alias("p_blocks")), [f"p_{c}" for c in keys]).withColumn("p_block", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1))).drop("p_blocks")
        return left.groupBy(*keys, "block").cogroup(spread.groupBy(*[f"p_{c}" for c in keys], "p_block")).applyInArrow(_searcher(k), RESULT)

    best = Window.partitionBy("query_row").orderBy(F.col("exact").desc(), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    nothing = F.lit(None).cast("binary")
    found = search(asked.join(F.broadcast(rest) if len(known) < MOST_CELLS else rest, "dim").withColumn("floor", nothing).withColumn("cell", F.lit(-1).cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    if cut.trees:
        done, floors = 0, None
        for many in (*ROUNDS, None):
            state = asked.join(floors, "query_row", "left") if floors is not None else asked.withColumn("floor", nothing)
            # bounds don't change and floors only cut the order's end, so the shards searched so far are the first ones of it
            stop = None if many is None else done + many
            wanted = state.select("query_id", "query_row", "q", "dim", "floor").mapInArrow(targets(done, stop), TARGETS)
            done = stop
            found = checkpoint(top(found.unionByName(search(wanted))).select("query_id", "query_row", "vec_id", "exact"))
            floors = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("exact")).alias("floor"))

    def shown(batches):
        import pyarrow as pa

        for batch in batches:
            score = [max(-LONG - 1, min(LONG, from_ordered(x))) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.int64())], names=["query_id", "rank", "vec_id", "score"])

    return top(found).select("query_id", "rank", "vec_id", "exact").mapInArrow(shown, "query_id long, rank int, vec_id long, score long")


def oracle(k: int = 5) -> str:
    return f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
t AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {k}"""
