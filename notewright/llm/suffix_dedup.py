"""Substring dedup over bytes, by a sparse suffix array sorted deep-shallow.

Anchors pick the suffixes to sort (see seeds): of each repeated anchor, the stretch of text that
holds all the windows it anchors. Stretches with the same anchor meet in one range and are
sorted: multikey quicksort over 8-byte characters to a shallow depth, then, for groups still
equal there, blind tries over the rest. Equal stretches end side by side, and all but those of
the least doc_id are covered whole; a task sorts what it gathers in the same way before it sends
on one stretch of each kind and document. Of what is left, one stretch of each kind in order, the
common prefix of neighbours tells which windows they share; only the first of such a chain goes on
as a suffix of its own. These suffixes are sorted likewise, and where neighbours in that order
have a window's length in common, those of larger doc_ids are covered. So a stretch that shares
only some of its windows loses only those.

Whole texts that equal one of a smaller doc_id, by size and two hashes, are settled first and not
sorted: a large group of copies would otherwise bring all its stretches to be compared.

Anchors with more than HOT_SHARE of all seeds are split, as edges of a frequent passage bring as
many unlike stretches as documents: there every window is a stretch of its own and goes to the
range of its own hash, one of each bucket's equal ones.

Stretches and windows are compared byte by byte.

Defined results: null texts are empty; texts shorter than a window stay; a null doc_id is larger
than all others and such rows leave each other alone, as do rows of one doc_id; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import seeds as S
from notewright.llm.arrowtext import _BYTE_CODE, mix, rolling, text_bytes
from notewright.llm.common import by_spot, checkpoint, in_ranges, ranges_of

WINDOW_BYTES, ANCHOR_BYTES = 50, 20
HOT_SHARE, HOT_LEAST = 1e-6, 20_000
SHALLOW_CHARACTERS = 3
FLUSH_UNITS, PIECE_UNITS, BLOCK_ROWS = 120_000, 30_000, 8192
UNITS = "spot int, ids binary, place binary, froms binary, sizes binary, anchors binary, stretches binary, spans binary"


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(max(0, len(data) - k + 1))
    return mix(rolling(_BYTE_CODE[data], at, at + k), 1)


def _finder(window: int, anchor: int):
    def find(data, offsets):
        grams = _grams(data, anchor)
        at, _, _ = S.anchors(grams, offsets, anchor, window)
        return grams[at], np.searchsorted(offsets, at, side="right") - 1

    return find


def multikey_quicksort(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): the rows sorted by their characters, and where one differs from the row before it.

    A quicksort by the first character of all; after that only rows that are equal so far are
    sorted, within their groups, by the next.
    """
    n, depth = columns.shape
    order = np.argsort(columns[:, 0])
    heads = np.ones(n, bool)
    heads[1:] = np.diff(columns[order, 0]) != 0
    for d in range(1, depth):
        sizes = np.diff(np.append(np.flatnonzero(heads), n))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_):
            break
        key, group = columns[order[open_], d], np.cumsum(heads[open_])
        along = np.lexsort((key, group))
        order[open_], key = order[open_[along]], key[along]
        heads[open_[1:]] |= key[1:] != key[:-1]
    return order, heads


def blind_tries(strings: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): rows of a byte matrix sorted within the groups that heads start, and where one differs from the row before.

    One blind trie a group, all grown together, level by level: a node looks only at the byte
    where its strings first differ, and its children share all before. A group without such a
    byte is a leaf.
    """
    n, width = strings.shape
    order, heads = np.arange(n), heads.copy()
    open_ = np.arange(n)
    while len(open_):
        first = np.flatnonzero(heads[open_])
        sizes = np.diff(np.append(first, len(open_)))
        many = np.repeat(sizes > 1, sizes)
        open_ = open_[many]
        if not len(open_):
            break
        first = np.flatnonzero(heads[open_])
        node = np.cumsum(heads[open_]) - 1
        depth = np.full(len(open_), width)
        for i in range(0, len(open_), BLOCK_ROWS):
            rows, own = strings[order[open_[i : i + BLOCK_ROWS]]], strings[order[open_[first[node[i : i + BLOCK_ROWS]]]]]
            differs = rows != own
            depth[i : i + BLOCK_ROWS] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        depth = np.minimum.reduceat(depth, first)[node]
        branching = depth < width
        open_, node, depth = open_[branching], node[branching], depth[branching]
        byte = strings[order[open_], depth]
        along = np.lexsort((byte, node))
        order[open_], byte = order[open_[along]], byte[along]
        heads[open_[1:]] |= byte[1:] != byte[:-1]
    return order, heads


def deep_shallow_sort(head: np.ndarray, tail) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads) of strings: their order, and where one differs from the string before it in that order.

    head: the first characters of 8 bytes of each, as numbers; tail(rows) the bytes that follow,
    as a matrix, asked only for strings that share their head with another.
    """
    order, heads = multikey_quicksort(head)
    sizes = np.diff(np.append(np.flatnonzero(heads), len(head)))
    deep = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(deep):
        inner, marks = blind_tries(tail(order[deep]), heads[deep])
        order[deep], heads[deep] = order[deep[inner]], marks
    return order, heads


def _kinds(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, kind) of the rows of a matrix whose last byte used is their size: kind numbers equal rows alike, in order."""
    head = np.ascontiguousarray(stretches[:, : 8 * SHALLOW_CHARACTERS]).view(">u8").astype(np.uint64)
    order, heads = deep_shallow_sort(head, lambda rows: stretches[rows, 8 * SHALLOW_CHARACTERS :])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(heads) - 1
    return order, kind


def _common_prefixes(lines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes each row of a padded matrix has in common with the row before it."""
    out = np.zeros(len(lines), np.int64)
    for i in range(1, len(lines), BLOCK_ROWS):
        differs = lines[i : i + BLOCK_ROWS] != lines[i - 1 : i - 1 + len(lines[i : i + BLOCK_ROWS])]
        out[i : i + BLOCK_ROWS] = np.where(differs.any(axis=1), differs.argmax(axis=1), lines.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def _characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; short of them at the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def _stretch_matrix(data: np.ndarray, low: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows data[low : low + size], zero padded, the size in a last byte."""
    out = np.zeros((len(low), -(-(width + 1) // 8) * 8), np.uint8)
    for i in range(0, len(low), BLOCK_ROWS):  # positions take eight times the bytes
        at = low[i : i + BLOCK_ROWS, None] + np.arange(width)
        inside = np.arange(width) < size[i : i + BLOCK_ROWS, None]
        out[i : i + BLOCK_ROWS, :width] = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0)
    out[:, width] = size
    return out


def _frequent(least: float):
    """Of the seeds of one partition: anchors (as seeds.spot_and_low) that it holds more than `least` times.

    Seeds of an anchor are in two partitions at most: those written aside and the others.
    """

    def run(batches):
        import pyarrow as pa

        found, keys, counts, size, at = [], [], [], 0, None

        def reduced():
            known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return [known], [np.bincount(inverse, weights=np.concatenate(counts))]

        def done():
            if keys:
                (known,), (n,) = reduced()
                found.append(known[n > least].astype(np.uint64) | np.uint64(at << 32))

        for batch in batches:
            for spot, raw in zip(batch.column("spot").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if spot != at:
                    done()
                    keys, counts, size, at = [], [], 0, spot
                keys.append(np.frombuffer(raw, np.uint32))
                counts.append(np.ones(len(keys[-1])))
                size += len(keys[-1])
                if size > 1 << 21:
                    (keys, counts), size = reduced(), 0
        done()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["number"])

    return run


def _collect(window: int, anchor: int, ranges: int, hot: np.ndarray):
    """Stretches of each document's seeds, packed by range; those of bucket b settled here go as spot -1 - b."""
    width = 2 * window - anchor

    def flush(spot, doc, low, mark, matrix, table):
        import pyarrow as pa

        ids = np.array(table, np.int64).reshape(-1, 2)
        _, kind = _kinds(matrix)
        order = np.lexsort((ids[doc, 0], kind))
        first = np.append(True, kind[order][1:] != kind[order][:-1])
        least = np.empty(len(kind), np.int64)
        least[order] = ids[doc[order], 0][np.flatnonzero(first)][np.cumsum(first) - 1]
        later = ids[doc, 0] > least
        size = matrix[:, width].astype(np.int64)
        settled = S.span_table(doc[later], low[later], low[later] + size[later], ids, ranges)
        rows = [(-1 - home, i, b"", b"", n, b"", b"", s) for home, i, n, s in zip(*[c.to_pylist() for c in settled.columns], strict=True)]
        go = np.flatnonzero(~later)
        go = go[np.argsort(spot[go], kind="stable")]
        cuts = np.searchsorted(spot[go], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            u = go[cuts[r] : cuts[r + 1]]
            used, place = np.unique(doc[u], return_inverse=True)
            rows.append((int(r), ids[used].tobytes(), place.astype(np.uint16).tobytes(), low[u].astype(np.int32).tobytes(), size[u].astype(np.uint8).tobytes(), mark[u].tobytes(), matrix[u, :width][np.arange(width) < size[u][:, None]].tobytes(), b""))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
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
            if not len(mine) or known.is_left_out(i):
                continue
            raw = data[offsets[i] : offsets[i + 1]]
            grams = _grams(raw, anchor)
            at, low, high = S.anchors(grams, np.array([0, len(raw)]), anchor, window)
            numbers = S.spot_and_low(grams[at], ranges)
            keep = np.isin(numbers, mine)
            if not keep.any():
                continue
            at, low, high, numbers = at[keep], low[keep], high[keep], numbers[keep]
            spot = (numbers >> np.uint64(32)).astype(np.int64)
            split = np.isin(numbers, hot)
            if split.any():  # every window for itself
                reps = np.where(split, high - low + 1, 1)
                inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                alone = np.repeat(split, reps)
                at, low, high, spot = np.repeat(at, reps), np.repeat(low, reps) + inner, np.repeat(high, reps), np.repeat(spot, reps)
                high = np.where(alone, low, high)
                spot[alone] = (mix(rolling(_BYTE_CODE[raw], low[alone], low[alone] + window), 1) % np.uint64(ranges)).astype(np.int64)
            for a in range(0, len(low), PIECE_UNITS):
                b = min(a + PIECE_UNITS, len(low))
                parts.append((spot[a:b], np.full(b - a, len(table)), low[a:b], (at[a:b] - low[a:b]).astype(np.uint8), _stretch_matrix(raw, low[a:b], high[a:b] - low[a:b] + window, width)))
                table.append(ids[i])
                size += b - a
                if size > FLUSH_UNITS or len(table) > S.FLUSH_ROWS:
                    out.append(flush(*[np.concatenate(c) for c in zip(*parts, strict=True)], table))
                    parts, table, size = [], [], 0
        if parts:
            out.append(flush(*[np.concatenate(c) for c in zip(*parts, strict=True)], table))
        return pa.Table.from_batches(out, schema=layout)

    return run


def _sorted_spans(window: int, anchor: int, buckets: int):
    """Of one range: spans covered by windows of smaller doc_ids."""
    width = 2 * window - anchor

    def run(table):
        cols = {n: table.column(n).to_pylist() for n in ("ids", "place", "froms", "sizes", "anchors", "stretches")}
        doc, ids, base = [], [], 0
        for d, p in zip(cols["ids"], cols["place"], strict=True):
            ids.append(np.frombuffer(d, np.int64).reshape(-1, 2))
            doc.append(np.frombuffer(p, np.uint16).astype(np.int64) + base)
            base += len(ids[-1])
        doc, ids = np.concatenate(doc), np.concatenate(ids)
        low = np.concatenate([np.frombuffer(x, np.int32) for x in cols["froms"]]).astype(np.int64)
        size = np.concatenate([np.frombuffer(x, np.uint8) for x in cols["sizes"]]).astype(np.int64)
        flat = np.frombuffer(b"".join(cols["stretches"]), np.uint8)
        matrix = _stretch_matrix(flat, np.cumsum(size) - size, size, width)
        order, kind = _kinds(matrix)
        number = ids[doc, 0]
        least = np.full(int(kind.max()) + 1, S.NO_ID, np.int64)
        np.minimum.at(least, kind, number)
        whole = number > least[kind]
        # one stretch of each kind, in order, and of these the ones that share their anchor: equal windows have equal anchors
        shown = order[np.append(True, kind[order][1:] != kind[order][:-1])]
        mark = np.frombuffer(b"".join(cols["anchors"]), np.uint8)[shown].astype(np.int64)
        flat = matrix[shown, :width].ravel()
        place = np.arange(len(shown)) * width + mark
        _, named, many = np.unique(rolling(_BYTE_CODE[flat], place, place + anchor), return_inverse=True, return_counts=True)
        unlike = np.flatnonzero(many[named] > 1)
        slot = np.full(len(shown) + 1, len(unlike))  # of each kind; the others have no windows to compare
        slot[unlike] = np.arange(len(unlike))
        slot = slot[kind]
        shown = shown[unlike]
        if not len(shown):
            known, index = np.unique(ids, axis=0, return_inverse=True)
            return S.span_table(index.ravel()[doc[whole]], low[whole], low[whole] + size[whole], known, buckets)
        own, counts = least[unlike], size[shown] - window + 1
        lines = np.ascontiguousarray(matrix[shown, :width])
        fresh = np.maximum(0, np.minimum(counts, _common_prefixes(lines, size[shown]) - window + 1))  # windows before it are the neighbour's too
        lines = lines.ravel()
        del flat, matrix
        chains = []  # for each offset: stretches that have a window there, the number of its chain, and the chains' first ones
        for j in range(int(counts.max())):
            has = np.flatnonzero(j < counts)
            starts = np.flatnonzero(j >= fresh[has])
            chains.append((has, np.cumsum(j >= fresh[has]) - 1, has[starts], np.minimum.reduceat(own[has], starts)))
        begin = np.concatenate([first * width + j for j, (_, _, first, _) in enumerate(chains)])
        owner = np.concatenate([c[3] for c in chains])
        characters, shallow = _characters(lines), 8 * SHALLOW_CHARACTERS
        head = np.stack([characters[begin + 8 * d] for d in range(SHALLOW_CHARACTERS)], axis=1)
        del characters
        along, heads = deep_shallow_sort(head, lambda rows: lines[begin[rows][:, None] + np.arange(shallow, window)])
        # neighbours that are no heads have a whole window in common
        earliest = np.empty(len(begin), np.int64)
        earliest[along] = np.minimum.reduceat(owner[along], np.flatnonzero(heads))[np.cumsum(heads) - 1]
        del head, along, heads, begin, lines
        covered, at, done = [], [], 0
        for j, (has, chain, first, _) in enumerate(chains):
            hit = has[earliest[done + chain] < own[has]]  # for the least document of the kind
            covered.append(hit)
            at.append(np.full(len(hit), j))
            done += len(first)
        covered, at = np.concatenate(covered), np.concatenate(at)
        by_kind = np.argsort(covered, kind="stable")
        at, edges = at[by_kind], np.searchsorted(covered[by_kind], np.arange(len(own) + 2))
        # every stretch of the least document takes its kind's windows
        some = np.flatnonzero(~whole & (edges[slot + 1] > edges[slot]))
        reps = edges[slot[some] + 1] - edges[slot[some]]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        hits = at[np.repeat(edges[slot[some]], reps) + inner] + np.repeat(low[some], reps)
        docs, begins, stops = [doc[whole], np.repeat(doc[some], reps)], [low[whole], hits], [low[whole] + size[whole], hits + window]
        uniq, index = np.unique(ids, axis=0, return_inverse=True)
        return S.span_table(index.ravel()[np.concatenate(docs)], np.concatenate(begins), np.concatenate(stops), uniq, buckets)

    return run


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): spans are the byte intervals [from, to) removed, kept what remains."""
    if not 8 * SHALLOW_CHARACTERS < window or not anchor < window <= 255 - window + anchor:
        raise ValueError("a stretch, 2 * window - anchor bytes, must fit in 255")
    rows = S.keyed(docs, text)
    ranges = ranges_of(rows)
    same = ["text_key", "size", "crc"]
    ident = checkpoint(rows.select("ord", "text_key", F.octet_length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")))
    copies = checkpoint(ident.join(ident.groupBy(*same).agg(F.min("ord").alias("first")), same).where("ord > first").select("ord", "text_key").distinct())
    # what equals a text of a smaller doc_id is removed whole; buckets hear of it like of seeds and spans
    raw = lambda c: F.unhex(F.lpad(F.hex(F.col(c)), 16, "0"))
    told = copies.select(S.bucket(ranges).alias("bucket"), F.concat(raw("ord"), raw("text_key")).alias("ids"))
    found = checkpoint(S.seeds(rows, _finder(window, anchor), ranges, True))
    total = found.agg(F.coalesce(F.sum(F.length("keys") / 4), F.lit(0))).first()[0]
    frequent = found.select("spot", "keys").mapInArrow(_frequent(max(HOT_LEAST, total * HOT_SHARE)), "number long").distinct().collect()  # at most 1 / HOT_SHARE rows
    hot = np.array([r.number for r in frequent], np.int64).view(np.uint64)
    out = told.select("bucket", F.lit(S.LEFT_OUT).alias("spot"), "ids", F.unhex(F.lit("00000000")).alias("counts"), F.unhex(F.lit("")).alias("keys"))
    units = by_spot(S.beside(rows, found.unionByName(out), ranges, _collect(window, anchor, ranges, hot), UNITS), ranges)

    def settled(rows):
        import pyarrow as pa

        home = pa.array(-1 - rows.column("spot").to_numpy(), pa.int32())
        return pa.table([home, rows.column("ids"), rows.column("sizes"), rows.column("spans")], names=["bucket", "ids", "counts", "spans"])

    spans = units.mapInArrow(in_ranges(_sorted_spans(window, anchor, ranges), settled), S.SPANS).withColumn("spot", F.lit(0))
    spans = spans.unionByName(out.withColumnRenamed("keys", "spans"))

    def cut(docs_, rows_):
        import pyarrow as pa

        gone_of, out_ = S.OfDocuments(docs_, rows_, "spans", np.int32, 2), []
        for i, raw in enumerate(docs_.column("text").to_pylist()):
            data = raw.encode()
            merged = S.merged(gone_of[i])
            if gone_of.is_left_out(i):
                merged = [(0, len(data))] if len(data) >= window else []
            edges = [0, *(x for ab in merged for x in ab), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out_.append((len(data), len(data) - len(kept), [{"from": a, "to": b} for a, b in merged], kept))
        n, gone, spans_, kept_ = zip(*out_, strict=True) if out_ else ([],) * 4
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.table([docs_.column("ord"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, span), pa.array(kept_, pa.binary())], names=["ord", "n_bytes", "n_removed", "spans", "kept"])

    done = S.beside(rows, spans, ranges, cut, "ord long, n_bytes long, n_removed long, spans array<struct<from:int,to:int>>, kept binary")
    return done.withColumn("doc_id", F.nullif(F.col("ord"), F.lit(S.NO_ID))).drop("ord")
