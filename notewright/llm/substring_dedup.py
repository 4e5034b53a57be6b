"""Substring dedup by seed and extend, over words.

Documents join on winnowed anchors (see seeds). Every seed is extended both ways to all the
windows it anchors; windows that occur at least twice anywhere are kept, and windows that touch
or overlap merge into the maximal repeats. The whole extension of a seed is compared first: most
are equal as a whole, and of those only one goes on, marked, to be compared window by window
with the ones that differ.

Extensions meet by the hash of their anchor. Anchors with more than HOT_SHARE of all seeds (at
most 1 / HOT_SHARE of them, so their list is small) are split: there every window meets by its
own hash, which spreads them evenly.

Words and windows are known by 64-bit hashes.

Defined results: null and empty texts have no words and stay; a text shorter than a window stays;
equal rows repeat each other; a null doc_id is a key like any other; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import seeds as S
from notewright.llm.arrowtext import Words, text_bytes
from notewright.llm.common import by_spot, checkpoint, in_ranges, ranges_of

WINDOW_WORDS, ANCHOR_WORDS = 35, 10
HOT_SHARE, HOT_LEAST = 1e-6, 20_000
FLUSH_WINDOWS = 1 << 20
UNITS = "spot int, wholes binary, marks binary, ids binary, froms binary, counts binary, windows binary"


def _finder(window: int, anchor: int):
    def find(data, offsets):
        w = Words(data, offsets)
        grams = w.grams(anchor)
        at, _, _ = S.anchors(grams, w.first, anchor, window)
        return grams[at], np.searchsorted(w.first, at, side="right") - 1

    return find


def _extend(window: int, anchor: int, ranges: int, hot: np.ndarray):
    """Rows of UNITS to compare elsewhere; those of bucket b that are settled here go as spot -1 - b, spans in `windows`."""

    def flush(route, whole, doc, start, count, windows, table):
        import pyarrow as pa

        ids = np.array(table, np.int64).reshape(-1, 2)
        at = np.cumsum(count) - count
        order = np.argsort(whole, kind="stable")
        first = np.zeros(len(order), bool)
        first[order] = np.append(True, whole[order][1:] != whole[order][:-1])
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(first[order]) - 1
        again = np.bincount(run)[run] > 1
        settled = S.span_table(doc[again], start[again], start[again] + count[again] - 1 + window, ids, ranges)
        rows = [(-1 - home, b"", b"", i, b"", n, s) for home, i, n, s in zip(*[c.to_pylist() for c in settled.columns], strict=True)]
        go = np.flatnonzero(first)
        spot = (route[go] % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(spot, kind="stable")
        go, spot = go[order], spot[order]
        cuts = np.searchsorted(spot, np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            u = go[cuts[r] : cuts[r + 1]]
            w = np.concatenate([windows[at[x] : at[x] + count[x]] for x in u])
            rows.append((int(r), whole[u].tobytes(), np.packbits(again[u]).tobytes(), ids[doc[u]].tobytes(), start[u].astype(np.int32).tobytes(), count[u].astype(np.uint8).tobytes(), w.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=[f.split()[0] for f in UNITS.split(", ")])

    def run(docs, rows):
        import pyarrow as pa

        layout = pa.schema([("spot", pa.int32()), *[(f.split()[0], pa.binary()) for f in UNITS.split(", ")[1:]]])
        parts, table, size, out = [], [], 0, []
        data, offsets = text_bytes(docs.column("text"))
        ids = list(zip(docs.column("ord").to_pylist(), docs.column("text_key").to_pylist(), strict=True))
        known = S.OfDocuments(docs, rows, "keys", np.uint32)
        for i in range(docs.num_rows):
            mine = known[i].ravel()
            if not len(mine):
                continue
            w = Words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            grams = w.grams(anchor)
            at, low, high = S.anchors(grams, w.first, anchor, window)
            numbers = S.spot_and_low(grams[at], ranges)
            keep = np.isin(numbers, mine)
            if not keep.any():
                continue
            at, low, high, numbers = at[keep], low[keep], high[keep], numbers[keep]
            prints = w.grams(window, 0xA0761D6478BD642F)
            split = np.isin(numbers, hot)
            if split.any():  # every window for itself
                reps = np.where(split, high - low + 1, 1)
                inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                alone = np.repeat(split, reps)
                low, high, numbers = np.repeat(low, reps) + np.where(alone, inner, 0), np.repeat(high, reps), np.repeat(numbers, reps)
                high = np.where(alone, low, high)
                numbers = np.where(alone, prints[low], numbers)
            count = high - low + 1
            flat = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            windows = prints[flat]
            begin = np.cumsum(count) - count
            step = (flat - np.repeat(low, count)).astype(np.uint64)
            whole = np.add.reduceat((windows ^ (step * np.uint64(0x9E3779B97F4A7C15))) * (step * np.uint64(2) + np.uint64(0xE7037ED1A0B428DB)), begin) ^ (count.astype(np.uint64) << np.uint64(57))
            parts.append((numbers, whole, np.full(len(low), len(table)), low, count, windows))
            table.append(ids[i])
            size += len(windows)
            if size > FLUSH_WINDOWS:
                out.append(flush(*[np.concatenate(c) for c in zip(*parts, strict=True)], table))
                parts, table, size = [], [], 0
        if parts:
            out.append(flush(*[np.concatenate(c) for c in zip(*parts, strict=True)], table))
        return pa.Table.from_batches(out, schema=layout)

    return run


def _compare(window: int, buckets: int):
    """Of one range: the spans of windows that occur twice."""

    def run(table):
        cols = {n: table.column(n).to_pylist() for n in ("wholes", "marks", "ids", "froms", "counts", "windows")}
        whole = np.concatenate([np.frombuffer(x, np.uint64) for x in cols["wholes"]])
        marks = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(x) // 8].astype(bool) for m, x in zip(cols["marks"], cols["wholes"], strict=True)])
        ids = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in cols["ids"]])
        start = np.concatenate([np.frombuffer(x, np.int32) for x in cols["froms"]]).astype(np.int64)
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in cols["counts"]]).astype(np.int64)
        windows = np.concatenate([np.frombuffer(x, np.uint64) for x in cols["windows"]])
        order = np.argsort(whole, kind="stable")
        first = np.append(True, whole[order][1:] != whole[order][:-1])
        run_of = np.empty(len(order), np.int64)
        run_of[order] = np.cumsum(first) - 1
        twice = (np.bincount(run_of) > 1) | (np.bincount(run_of, weights=marks) > 0)
        one = np.zeros(len(order), bool)
        one[order[first]] = True
        unit = np.repeat(np.arange(len(count)), count)
        shown = one[unit]  # one extension of each kind, counted twice if it occurs twice
        prints, inverse = np.unique(windows[shown], return_inverse=True)
        often = np.bincount(inverse, weights=np.where(twice[run_of[unit[shown]]], 2, 1), minlength=len(prints)) > 1
        covered = np.zeros(len(windows), bool)
        covered[shown] = often[inverse]
        covered[twice[run_of[unit]]] = True
        begin = (np.repeat(start, count) + np.arange(len(windows)) - np.repeat(np.cumsum(count) - count, count))[covered]
        if not len(begin):
            return S.span_table(np.zeros(0, np.int64), begin, begin, ids, buckets)
        known, doc = np.unique(ids, axis=0, return_inverse=True)
        return S.span_table(doc.ravel()[unit[covered]], begin, begin + window, known, buckets)

    return run


def settled_spans(rows):
    """Spans that were settled where they were found, as rows of seeds.SPANS."""
    import pyarrow as pa

    home = pa.array(-1 - rows.column("spot").to_numpy(), pa.int32())
    return pa.table([home, rows.column("ids"), rows.column("counts"), rows.column("windows")], names=["bucket", "ids", "counts", "spans"])


def repeats(docs: DataFrame, text: str = "text", window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, text, spans, n_words...) of every row: spans are the word intervals [from, to) of maximal
    repeats, as an array, with n_words, n_removed, kept (the words outside them, joined by a space)."""
    if not anchor < window <= 255:
        raise ValueError("a window must be longer than its anchor and at most 255 words")
    rows = S.keyed(docs, text)
    ranges = ranges_of(rows)
    found = checkpoint(S.seeds(rows, _finder(window, anchor), ranges, False))
    counted = found.select(F.explode(F.sequence(F.lit(0), (F.length("keys") / 4).cast("int") - 1)).alias("i"), "spot", "keys").select("spot", F.substring("keys", F.col("i") * 4 + 1, F.lit(4)).alias("low"))
    total = found.agg(F.coalesce(F.sum(F.length("keys") / 4), F.lit(0))).first()[0]
    frequent = counted.groupBy("spot", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_LEAST, total * HOT_SHARE)).collect()  # at most 1 / HOT_SHARE rows
    hot = np.array([(r.spot << 32) | int.from_bytes(r.low, "little") for r in frequent], np.uint64)
    units = by_spot(S.beside(rows, found, ranges, _extend(window, anchor, ranges, hot), UNITS), ranges)
    spans = units.mapInArrow(in_ranges(_compare(window, ranges), settled_spans), S.SPANS)

    def cut(docs_, rows_):
        import pyarrow as pa

        gone_of, out = S.OfDocuments(docs_, rows_, "spans", np.int32, 2), []
        for i, raw in enumerate(docs_.column("text").to_pylist()):
            words = raw.encode().split()
            kept, merged = words, S.merged(gone_of[i])
            if merged:
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            out.append((len(words), len(words) - len(kept), [{"from": a, "to": b} for a, b in merged], b" ".join(kept).decode()))
        n, gone, spans_, kept_ = zip(*out, strict=True) if out else ([],) * 4
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.table([docs_.column("ord"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, span), pa.array(kept_, pa.string())], names=["ord", "n_words", "n_removed", "spans", "kept"])

    done = S.beside(rows, spans, ranges, cut, "ord long, n_words long, n_removed long, spans array<struct<from:int,to:int>>, kept string")
    return done.withColumn("doc_id", F.nullif(F.col("ord"), F.lit(S.NO_ID))).drop("ord")
