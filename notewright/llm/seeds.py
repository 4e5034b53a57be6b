"""Repeated anchors: where long matches between documents can lie.

A window of `width` units (words or bytes) is anchored at the k-gram of least hash in it, so
equal windows have equal anchors at equal offsets, wherever they are. An anchor that occurs once
rules out every window it anchors; the others are seeds. Anchors travel packed: 32 bits of the
hash (the range they go to fixes more bits; chance repeats only cost later work) and the number
of their document among those a task gathered. An anchor that a task meets twice is a seed at
once and goes on only once, so a frequent anchor brings its range one entry a flush.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.arrowtext import groups, text_bytes, window_minima
from notewright.llm.common import by_spot, in_ranges

FLUSH_BYTES, FLUSH_ROWS = 24 << 20, 60_000
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ord, text_key, text): null texts empty; ord is the doc_id, null ones after all others."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64(t).alias("text_key"), t.alias("text"))


def anchors(grams: np.ndarray, first: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, its anchor's position) runs: anchor positions with the first and last window each anchors.

    grams: hash of the k units from each unit on; first: unit offsets of the documents.
    """
    spans = width - k + 1
    lowest = window_minima(grams, spans)
    n = np.diff(first)
    starts = np.arange(len(lowest))
    doc_end = np.repeat(first[1:], n)[: len(lowest)]
    ok = starts + width <= doc_end
    starts, at = starts[ok], lowest[ok]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.ones(len(at), bool)
    # a new run at another anchor, and at the next document
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], len(at)) - 1
    return at[begin].astype(np.int64), starts[begin], starts[stop]


def spot_and_low(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range and low 32 bits of each hash, as one number."""
    return (((hashes >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _rows(keys: np.ndarray, index: np.ndarray, marks: np.ndarray, table: list[tuple[int, int]], aside: bool):
    """One packed row for each range that keys (sorted) fall in; aside rows are numbered from -1 down."""
    spots = (keys >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(spots[1:] != spots[:-1]) + 1).tolist(), len(spots)] if len(spots) else []
    ids = np.array(table, np.int64).reshape(-1, 2)
    for a, b in zip(cuts, cuts[1:]):
        used, place = np.unique(index[a:b], return_inverse=True)
        spot = int(spots[a])
        yield (-1 - spot if aside else spot, keys[a:b].astype(np.uint32).tobytes(), place.astype(np.uint16).tobytes(), np.packbits(marks[a:b]).tobytes(), ids[used].tobytes())


PACKED = "spot int, keys binary, place binary, marks binary, ids binary"


def _pack(find, ranges: int, once_a_doc: bool):
    def flush(keys, index, table):
        import pyarrow as pa

        if once_a_doc:
            order = np.lexsort((index, keys))
            keys, index = keys[order], index[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (index[1:] != index[:-1])
            keys, index = keys[fresh], index[fresh]
        else:
            order = np.argsort(keys, kind="stable")
            keys, index = keys[order], index[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        again = np.zeros(len(keys), bool)
        again[:-1] = ~first[1:]
        again |= ~first
        rows = [*_rows(keys[first], index[first], again[first], table, False), *_rows(keys[again], index[again], again[again], table, True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["spot", "keys", "place", "marks", "ids"])

    def run(batches):
        keys, index, table, size = [], [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = list(zip(batch.column("ord").to_pylist(), batch.column("text_key").to_pylist(), strict=True))
            for i, j in groups(offsets):
                hashes, docs = find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys.append(spot_and_low(hashes, ranges))
                index.append((docs + len(table)).astype(np.uint16))
                table += ids[i:j]
                size += int(offsets[j] - offsets[i])
                if size > FLUSH_BYTES or len(table) > FLUSH_ROWS - 2000:
                    yield flush(np.concatenate(keys), np.concatenate(index), table)
                    keys, index, table, size = [], [], [], 0
        if table:
            yield flush(np.concatenate(keys), np.concatenate(index), table)

    return run


def bucket(buckets: int) -> Column:
    """The bucket of documents that a row of keyed() belongs to; copies of a text are spread by their ids."""
    return F.pmod(F.col("text_key").bitwiseXOR(F.col("ord")), F.lit(buckets)).cast("int")


def by_bucket(ids: np.ndarray, owner: np.ndarray, buckets: int):
    """What documents own, packed by their bucket: yields (bucket, ids, number each owns, order), where
    order picks the owned things, document by document. owner: the row of ids that owns each."""
    home = (ids[:, 0] ^ ids[:, 1]) % buckets
    order = np.lexsort((owner, home[owner]))
    sorted_home = home[owner[order]]
    cuts = np.flatnonzero(np.append(True, sorted_home[1:] != sorted_home[:-1])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        used, counts = np.unique(owner[order[a:b]], return_counts=True)
        yield int(sorted_home[a]), ids[used], counts, order[a:b]


SEEDS = "bucket int, spot int, ids binary, counts binary, keys binary"
#: A row with this spot names documents that are left out, its ids written with the high byte first.
LEFT_OUT = -(1 << 31)


def _seed_table(keys: np.ndarray, index: np.ndarray, ids: np.ndarray, spot: int, buckets: int):
    import pyarrow as pa

    order = np.lexsort((keys, index))
    keys, index = keys[order], index[order]
    rows = [(home, spot, i.tobytes(), n.astype(np.uint32).tobytes(), keys[at].tobytes()) for home, i, n, at in by_bucket(ids, index, buckets)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "spot", "ids", "counts", "keys"])


def _repeated(buckets: int):
    def run(table):
        spot = table.column("spot")[0].as_py()
        keys, index, marks, ids, n = [], [], [], [], 0
        for k, p, m, d in zip(*[table.column(c).to_pylist() for c in ("keys", "place", "marks", "ids")], strict=True):
            keys.append(np.frombuffer(k, np.uint32))
            index.append(np.frombuffer(p, np.uint16).astype(np.int64) + n)
            marks.append(np.unpackbits(np.frombuffer(m, np.uint8))[: len(keys[-1])].astype(bool))
            ids.append(np.frombuffer(d, np.int64).reshape(-1, 2))
            n += len(ids[-1])
        keys, index, marks, ids = map(np.concatenate, (keys, index, marks, ids))
        order = np.argsort(keys, kind="stable")
        keys, index, marks = keys[order], index[order], marks[order]
        first = np.append(True, keys[1:] != keys[:-1])
        run_of = np.cumsum(first) - 1
        known = np.bincount(run_of, weights=marks) > 0
        many = (np.bincount(run_of) > 1) | known
        take = many[run_of] & ~marks  # what is marked is a seed already
        return _seed_table(keys[take], index[take], ids, spot, buckets)

    return run


def _settled(buckets: int):
    def run(table):
        keys, index, ids, n = [], [], [], 0
        for k, p, d in zip(*[table.column(c).to_pylist() for c in ("keys", "place", "ids")], strict=True):
            keys.append(np.frombuffer(k, np.uint32))
            index.append(np.frombuffer(p, np.uint16).astype(np.int64) + n)
            ids.append(np.frombuffer(d, np.int64).reshape(-1, 2))
            n += len(ids[-1])
        return _seed_table(*map(np.concatenate, (keys, index, ids)), -1 - table.column("spot")[0].as_py(), buckets)

    return run


def seeds(docs: DataFrame, find, ranges: int, once_a_doc: bool) -> DataFrame:
    """SEEDS rows: the seeds of documents, by bucket and range, as 32-bit numbers.

    find(data, offsets) gives the anchors' hashes and document numbers of some documents. With
    once_a_doc, an anchor must occur in two rows of docs; else two places of one row will do.
    There are as many buckets as ranges, so a row holds the seeds of several documents.
    """
    packed = by_spot(docs.select("ord", "text_key", "text").mapInArrow(_pack(find, ranges, once_a_doc), PACKED), ranges)
    return packed.mapInArrow(in_ranges(_repeated(ranges), _settled(ranges)), SEEDS)


class OfDocuments:
    """What packed rows hold for each document of one bucket."""

    def __init__(self, docs, rows, values: str, kind, width: int = 1):
        keys = list(zip(docs.column("ord").to_pylist(), docs.column("text_key").to_pylist(), strict=True))
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        self.of_row = [number[k] for k in keys]
        owners, found, self.spots = [], [], []
        spots = rows.column("spot").to_pylist() if "spot" in rows.column_names else [0] * rows.num_rows
        self.left_out = set()
        for spot, i, n, v in zip(spots, *[rows.column(c).to_pylist() for c in ("ids", "counts", values)], strict=True):
            pairs = np.frombuffer(i, ">i8" if spot == LEFT_OUT else np.int64).reshape(-1, 2)
            who = np.array([number.get(tuple(x), -1) for x in pairs.tolist()], np.int64)
            if spot == LEFT_OUT:
                self.left_out.update(who.tolist())
                continue
            what = np.frombuffer(v, kind).reshape(-1, width)
            owners.append(np.repeat(who, np.frombuffer(n, np.uint32)))
            found.append(what if spot == 0 else what.astype(np.uint64) | np.uint64(spot << 32))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.values = np.concatenate([x.astype(np.uint64) if width == 1 else x for x in found]) if found else np.zeros((0, width), np.uint64 if width == 1 else kind)
        order = np.argsort(owner, kind="stable")
        self.values = self.values[order]
        self.ends = np.searchsorted(owner[order], np.arange(len(number) + 1))

    def __getitem__(self, row: int) -> np.ndarray:
        """The values of the document in a row of docs."""
        i = self.of_row[row]
        return self.values[self.ends[i] : self.ends[i + 1]]

    def is_left_out(self, row: int) -> bool:
        return self.of_row[row] in self.left_out


SPANS = "bucket int, ids binary, counts binary, spans binary"


def span_table(doc: np.ndarray, begin: np.ndarray, stop: np.ndarray, ids: np.ndarray, buckets: int):
    """SPANS rows from intervals [begin, stop) of documents; those of a document that touch are merged."""
    import pyarrow as pa

    order = np.lexsort((begin, doc))
    doc, begin, stop = doc[order], begin[order], stop[order]
    fresh = np.ones(len(doc), bool)
    if len(doc):
        shift = doc.astype(np.int64) << 40  # one running maximum for all documents
        reach = np.maximum.accumulate(stop + shift)
        fresh[1:] = begin[1:] + shift[1:] > reach[:-1]
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)
        doc, begin, stop = doc[fresh], begin[fresh], reach[last] - shift[last]
    rows = [(home, i.tobytes(), n.astype(np.uint32).tobytes(), np.stack([begin[at], stop[at]], 1).astype(np.int32).tobytes()) for home, i, n, at in by_bucket(ids, doc, buckets)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "ids", "counts", "spans"])


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of a document's intervals, in order."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.append(True, spans[1:, 0] > reach[:-1])
    return list(zip(spans[fresh, 0].tolist(), reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)].tolist(), strict=True))


def beside(docs: DataFrame, rows: DataFrame, buckets: int, run, schema: str) -> DataFrame:
    """run(documents, packed rows) of each bucket; every document is in one, some 4,096 or 16 MB together."""
    return docs.withColumn("bucket", bucket(buckets)).groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(run, schema)
