"""Mixture-controlled packing: deficit round-robin over source queues.

Documents queue by source, in an order that a hash of their id fixes. Deficit round-robin fills
sequence after sequence in grains, 16 a sequence: each grain goes to the source whose deficit -
its share of the tokens dealt so far less what it got - is largest. A sequence therefore holds
its 16 most indebted sources, and what it could not give a source is carried on, across sequences
and partitions: at any point no source is more than a grain or two off its share of all tokens
dealt. Shares are whole numbers of grains per period, after which all deficits are back to zero;
the deal of one period therefore holds for every period, and any document's pieces follow from
its position in its queue alone, in any task, in any order. When a source runs out, one closing
period uses it up and the shares of the others are reckoned anew. The last, short sequence is cut
into sequences of powers of two, so nothing is padded.

MOST_QUEUES sources have queues of their own, those with weights first and then the largest; all
others share one queue, in hashed order, so the deal's size and the driver's share of the work are
bounded however many sources there are.

Defined results: a null text is an empty one and yields its end token; a null source is a source
of its own; rows of one doc_id queue side by side; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import checkpoint, shared_table, shuffle_parts
from notewright.llm.tokens import forget, tokenizer

SEQUENCE, GRAIN, PERIOD_SEQUENCES = 2048, 128, 128
END_ID = 1
#: Sources with a queue of their own; a period has some four grains for each.
MOST_QUEUES = 512
#: Documents of all sources that share a bucket of the queue order, on average.
BUCKET_ROWS = 4096
#: Rows of the table of bucket positions up to which it is broadcast (some 100 bytes each).
BROADCAST_BUCKETS = 500_000
NO_SOURCE, OTHERS = "\x00", "\x01"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@dataclass(frozen=True)
class Phase:
    """A deal that repeats: `repeats` periods of `sequences` sequences from sequence `base` on.

    per_source: name -> (queue position at its start, tokens a period, and of each of its
    segments: start within the period's tokens, sequence, offset there).
    """

    base: int
    repeats: int
    sequences: int
    per_source: dict[str, tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]


def deal(tokens: Mapping[str, int], rooms: list[int], grain: int) -> dict[str, list[tuple[int, int, int]]]:
    """Fill sequences of the given rooms with all of tokens: source -> [(start, sequence, offset)].

    Neighbouring segments of one source in one sequence are merged.
    """
    names = sorted(tokens)
    quota = np.array([tokens[n] for n in names], float)
    served, total, dealt = np.zeros(len(names)), float(quota.sum()), 0
    out: dict[str, list[tuple[int, int, int]]] = {n: [] for n in names}
    last = None
    for sequence, room in enumerate(rooms):
        at = 0
        while at < room:
            left = quota - served
            deficit = np.where(left > 0, quota * ((dealt + grain) / total) - served, -np.inf)
            i = int(deficit.argmax())
            n = int(min(grain, left[i], room - at))
            if last != (i, sequence):
                out[names[i]].append((int(served[i]), sequence, at))
            last = (i, sequence)
            served[i] += n
            at += n
            dealt += n
    return out


def _apportion(total: int, weights: Mapping[str, float], most: Mapping[str, int]) -> dict[str, int]:
    """Whole numbers that add up to total, in proportion to weights, each from 0 to most."""
    share, left, open_ = dict.fromkeys(weights, 0), total, sorted(weights)
    while left and open_:
        all_ = sum(weights[n] for n in open_)
        exact = {n: left * weights[n] / all_ for n in open_}
        full = [n for n in open_ if exact[n] >= most[n] - share[n]]
        if not full:
            for n in open_:
                share[n] += int(exact[n])
            rest = total - sum(share.values())
            for n in sorted(open_, key=lambda n: (int(exact[n]) - exact[n], n))[:rest]:
                share[n] += 1
            return share
        for n in full:
            left -= most[n] - share[n]
            share[n] = most[n]
        open_ = [n for n in open_ if n not in full]
    return share


def schedule(totals: Mapping[str, int], weights: Mapping[str, float] | None = None, sequence: int = SEQUENCE, grain: int = GRAIN, period: int = PERIOD_SEQUENCES) -> list[Phase]:
    """Phases that use up every queue. totals: tokens by queue; weights default to totals, and a
    queue without one comes last.

    Work and memory follow the number of queues, not the corpus.
    """
    left = {n: int(t) for n, t in totals.items() if t > 0}
    weight = {n: float((weights or totals).get(n, 0) or 1e-9) for n in left}
    at, base, phases = dict.fromkeys(left, 0), 0, []

    def add(quota: dict[str, int], rooms: list[int], repeats: int) -> None:
        nonlocal base
        quota = {n: q for n, q in quota.items() if q}
        segments = deal(quota, rooms, grain)
        phases.append(Phase(base, repeats, len(rooms), {n: (at[n], q, *(np.array(c, np.int64) for c in zip(*segments[n], strict=True))) for n, q in quota.items()}))
        base += len(rooms) * repeats
        for n, q in quota.items():
            at[n] += q * repeats
            left[n] -= q * repeats
            if not left[n]:
                del left[n]

    def shares(sequences: int) -> tuple[dict[str, int], int]:
        """Whole grains of a period for every queue that has one left, and how often that can be dealt."""
        grains = sequences * sequence // grain
        large = [n for n in left if left[n] >= grain]
        quota = {n: q * grain for n, q in _apportion(grains, {n: weight[n] for n in large}, dict.fromkeys(large, grains)).items()}
        for n in large:  # a small share still gets a grain a period
            if not quota[n] and quota[most := max(quota, key=quota.get)] > grain:
                quota[n], quota[most] = grain, quota[most] - grain
        repeats = min((left[n] // q for n, q in quota.items() if q), default=0)
        if not all(quota.values()):
            return quota, 0
        return quota, max(0, repeats - (len(large) < len(left)))

    while (all_ := sum(left.values())) >= sequence:
        sequences = min(period, all_ // sequence)
        least = min(sequences, -(-4 * len(left) * grain // sequence))
        quota, repeats = shares(sequences)
        while not repeats and sequences > least:  # towards the end of a queue, shorter periods
            sequences = max(least, sequences // 2)
            quota, repeats = shares(sequences)
        if repeats:
            add(quota, [sequence] * sequences, repeats)
        else:  # use up what is about to end, the rest in proportion
            ending = {n: t for n, t in left.items() if t < grain}
            others = {n: weight[n] for n in left if n not in ending}
            add(ending | _apportion(sequences * sequence - sum(ending.values()), others, left), [sequence] * sequences, 1)
    if left:
        rest = sum(left.values())
        rooms = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        add(dict(left), rooms, 1)
    return phases


class Lane:
    """The segments of one queue, through all phases, as arrays that any position can be looked up in."""

    def __init__(self, phases: list[Phase], name: str):
        mine = [(p, *p.per_source[name]) for p in phases if name in p.per_source]
        column = lambda xs: np.array(xs, np.int64)
        self.base, self.sequences = column([p.base for p, *_ in mine]), column([p.sequences for p, *_ in mine])
        self.first, self.size = column([m[1] for m in mine]), column([m[2] for m in mine])
        self.count = column([len(m[3]) for m in mine])
        before = lambda xs: np.cumsum(xs) - xs
        repeats = column([p.repeats for p, *_ in mine])
        self.shift, self.slot, self.number = before(self.size), before(self.count), before(self.count * repeats)
        self.begins = np.concatenate([m[3] + s for m, s in zip(mine, self.shift, strict=True)])
        self.sequence, self.offset = np.concatenate([m[4] for m in mine]), np.concatenate([m[5] for m in mine])
        self.last, self.end = int((self.count * repeats).sum()) - 1, int(self.first[-1] + self.size[-1] * repeats[-1])

    def segment(self, at: np.ndarray) -> np.ndarray:
        """The number of the segment that holds each queue position."""
        p = np.searchsorted(self.first, at, side="right") - 1
        turn, inner = np.divmod(at - self.first[p], self.size[p])
        j = np.searchsorted(self.begins, self.shift[p] + inner, side="right") - 1
        return self.number[p] + turn * self.count[p] + j - self.slot[p]

    def where(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queue position, sequence, offset there) at which each segment starts."""
        p = np.searchsorted(self.number, segment, side="right") - 1
        turn, j = np.divmod(segment - self.number[p], self.count[p])
        j += self.slot[p]
        return self.first[p] + turn * self.size[p] + self.begins[j] - self.shift[p], self.base[p] + turn * self.sequences[p] + self.sequence[j], self.offset[j]

    def pieces(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the document, length, sequence, offset) of documents at queue positions [at, at + n)."""
        low = self.segment(at)
        counts = self.segment(at + n - 1) - low + 1
        row = np.repeat(np.arange(len(at)), counts)
        segment = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        start, sequence, offset = self.where(segment)
        stop = np.where(segment < self.last, self.where(np.minimum(segment + 1, self.last))[0], self.end)
        begin, stop = np.maximum(start, at[row]), np.minimum(stop, at[row] + n[row])
        return row, begin - at[row], stop - begin, sequence, offset + begin - start


def pack(docs: DataFrame, tokenizer_path: str, weights: Mapping[str, float] | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, text: str = "text", source: str = "source") -> DataFrame:
    """Pieces of all documents; see PIECES for the columns."""
    n_docs = docs.select(F.count(F.lit(1))).first()[0]
    buckets = max(1, n_docs // BUCKET_ROWS)
    keys = ["source", "bucket"]
    queued = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("source"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartition(shuffle_parts(docs.sparkSession), *keys)
        .sortWithinPartitions(*keys, "doc_id", F.crc32(F.col("text").cast("binary")))
    )

    def encode(batches):
        import gc

        gc.disable()  # no cycles here, and the table of words makes collections slow
        try:
            yield from encoded_batches(batches)
        finally:
            gc.enable()  # the worker goes on to other tasks

    def encoded_batches(batches):
        import pyarrow as pa

        words, at, run = tokenizer(tokenizer_path), None, 0
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                ids = [np.append(x, x.dtype.type(end_id)) for x in words.encode(batch.column("text").to_pylist())]
                starts = []
                for key, n in zip(zip(batch.column("source").to_pylist(), batch.column("bucket").to_pylist(), strict=True), map(len, ids), strict=True):
                    at, run = key, run if key == at else 0
                    starts.append(run)
                    run += n
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("bucket"), pa.array(starts, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "source", "bucket", "local", "n", "ids"])

    encoded = shared_table(queued.mapInArrow(encode, "doc_id long, source string, bucket long, local long, n long, ids binary"), "packed-ids")
    sums = checkpoint(encoded.groupBy(*keys).agg(F.sum("n").alias("tokens")))
    listed = list(weights or {})
    if len(listed) > MOST_QUEUES:
        raise ValueError(f"at most {MOST_QUEUES} sources can have weights")
    by_size = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.col("source").isin(listed).desc(), F.col("tokens").desc(), "source")
    totals = {r.source: r.tokens for r in by_size.limit(MOST_QUEUES).collect()}
    own = docs.sparkSession.createDataFrame([(n, n) for n in totals], "source string, queue string")
    named = sums.join(F.broadcast(own), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(OTHERS)))
    rest = named.where(F.col("queue") == OTHERS).agg(F.sum("tokens")).first()[0]
    phases = schedule(totals | ({OTHERS: rest} if rest else {}), weights, sequence)
    lanes = {name: Lane(phases, name) for name in {n for p in phases for n in p.per_source}}
    # a queue's order: bucket by bucket, and within one source by source
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = named.groupBy("queue", "bucket").agg(F.sum("tokens").alias("tokens")).select("queue", "bucket", F.coalesce(F.sum("tokens").over(before("queue", "bucket")), F.lit(0)).alias("block"))
    within = named.select("queue", *keys, F.coalesce(F.sum("tokens").over(before("queue", "bucket", "source")), F.lit(0)).alias("within"))
    positions = within.join(blocks, ["queue", "bucket"]).select(*keys, "queue", (F.col("block") + F.col("within")).alias("base"))
    if sums.count() <= BROADCAST_BUCKETS:
        positions = F.broadcast(positions)
    placed = encoded.join(positions, keys).select("doc_id", "source", "queue", (F.col("base") + F.col("local")).alias("at"), "n", "ids")

    def cut(batches):
        import pyarrow as pa

        forget()  # all ids are written: what encoding left in this worker is not needed again
        for batch in batches:
            doc_id, name, queue, ids = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            at, n = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            members: dict[str, list[int]] = {}
            for i, q in enumerate(queue):
                members.setdefault(q, []).append(i)
            found = [np.zeros((5, 0), np.int64)]
            for q, mine in members.items():
                i = np.array(mine)
                row, *rest_ = lanes[q].pieces(at[i], n[i])
                found.append(np.stack([i[row], *rest_]))
            row, start, length, sequence_id, offset = np.concatenate(found, axis=1)
            wide = [np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32).astype("<u4").data.cast("B") for x, k in zip(ids, n.tolist(), strict=True)]
            rows = row.tolist()
            crcs = [zlib.crc32(wide[r][4 * a : 4 * b]) for r, a, b in zip(rows, start.tolist(), (start + length).tolist(), strict=True)]
            sources = [None if x == NO_SOURCE else x for x in name]
            columns = [pa.array([doc_id[r] for r in rows], pa.int64()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[row]), pa.array(sequence_id), pa.array(offset), pa.array([sources[r] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)
