"""N-gram Jaccard join by parity sketches.

Each shingle toggles one bit of a wide bit sketch, so the Hamming distance of two sketches never
exceeds the symmetric difference of the two sets, and that is at most (a + b) / 9 for linked sets
of a and b shingles. Per size band, from 8 shingles up, the sketch is cut into half as many parts
as a set of the band has shingles at most; one part more than the bound would have to agree. Of
its parts with a set bit a set joins on the floor(a / 4) + 1 that hold most bits: if at most D
parts differ, the first D + 1 parts of either in any order common to both must meet, and fuller
parts are the rarer ones. A set whose shingles fall in so few parts that all of them may differ
also joins on finer parts; a partner that shares no part with it is in the same case, so both meet
there. Parts are stored by a 47-bit digest (the exclusive or of their bits' hashes); what meets by
chance is sorted out by the Hamming bound of a second, 1024-bit sketch and by exact verification.

Parts that many documents hold - those of a passage or a line that unlike documents have in common -
come after all others in the order, whatever bits they hold: all parts of all documents are counted
in CELLS cells by their digest, where sketches are made, and the fullest cells come last. As any
common order gives the same links, shared cells only cost later work. So only sets that consist of
such parts almost wholly still meet in them.

Equal sets are one class from the start. A part shared by few classes yields all its pairs; of a
part shared by many, each is first compared with a centre (the class in most of such parts). That
joins groups of near copies. In parts that are still shared by several components, pairs across
components that pass the size and Hamming bounds are compared. That keeps every link that can
change a component without listing the pairs within groups of near copies or within those that
share a passage.

A class is known by a 64-bit sum of its shingles' hashes, shingles by 64-bit hashes.

Defined results: a null text or one without words has no shingles and is linked with nothing;
a text of 1 to 4 words is one shingle of its own; equal rows are linked with each other; rows of
one doc_id but different texts are told apart by text_key and each is in the component of its own
text; a row without doc_id gets, as component, that of equal texts with one, or null, and is
linked with nothing else; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.arrowtext import Words, groups, mix, text_bytes
from notewright.llm.common import by_spot, checkpoint, in_ranges, ranges_of, shared_table
from notewright.llm.components import components, joined
from notewright.llm.tokens import forget

SHINGLE_WORDS = 5
SKETCH_BITS = 1024
#: Sets below this many shingles are one band; above, bands double. Finer parts are so many times as many.
FIRST_BAND, FINER = 8, 1 << 12
#: Cells that count parts, and how many of them are put last at most, as 4 bytes each in every task.
CELLS, MOST_LAST = 1 << 20, 65_536
#: A task tells of cells that hold so many parts more than so many times the mean.
CELL_LEAST, CELL_TIMES = 4, 4
#: Classes that share a part, up to which all their pairs are compared at once.
FEW = 16
#: Texts (bytes) and classes a task gathers before it writes its keys.
FLUSH_BYTES, FLUSH_CLASSES = 24 << 20, 60_000

def shingle_sets(column, k: int = SHINGLE_WORDS):
    """Yields (first row, n rows, row of each shingle, shingle), by row and ascending, distinct."""
    data, offsets = text_bytes(column)
    for i, j in groups(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        n, words = j - i, np.diff(w.first)
        row = np.repeat(np.arange(n), words)
        at = np.flatnonzero(np.arange(len(row)) + k <= w.first[1:][row]) if len(row) else np.zeros(0, np.int64)
        short = np.flatnonzero((words > 0) & (words < k))
        whole = np.array([mix(np.array([_fold(w.hashes[w.first[r] : w.first[r + 1]])], np.uint64), 2)[0] for r in short], np.uint64)
        rows, values = np.concatenate([row[at], short]), np.concatenate([w.grams(k)[at], whole])
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        yield i, n, rows[fresh], values[fresh]


def _fold(hashes: np.ndarray) -> int:
    x = len(hashes)
    for h in hashes.tolist():
        x = (x * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return x


def _classes(n: int, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set size and class of each row; class 0 for none."""
    sizes = np.bincount(rows, minlength=n)
    cls = np.zeros(n, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        cls[some] = mix(np.add.reduceat(mix(values, 7), (np.cumsum(sizes) - sizes)[some]) ^ mix(sizes[some].astype(np.uint64), 9), 4) | np.uint64(1)
    return sizes, cls


def band(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes < FIRST_BAND, 0, np.floor(np.log2(np.maximum(sizes, 1) / FIRST_BAND) + 1e-12).astype(np.int64) + 1)


def _digest(key: np.ndarray) -> np.ndarray:
    """47 bits of a key, the lowest bit of the result left free."""
    return key << np.uint64(1) >> np.uint64(17) << np.uint64(1)


def _cell(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(27)) % np.uint64(CELLS)).astype(np.int64)


def _split(r: np.ndarray, v: np.ndarray, layout: np.ndarray, parts: np.ndarray):
    """(row, digest, bits) of every part that has a bit."""
    part = ((v >> np.uint64(32)) * parts) >> np.uint64(32)
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(first)
    key = _digest(mix(np.bitwise_xor.reduceat(mix(v, 3), starts) ^ mix((part[starts] << np.uint64(8)) | layout[starts], 6), 8))
    return r[starts], key, np.diff(np.append(starts, len(r)))


def _layouts(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray):
    """Yields _split() of the layouts each set is cut by: that of its own band, that of the next where a
    linked set may lie there, and the finer ones of either where all parts may differ."""
    own, upper = band(sizes), band((sizes * 5) // 4)
    for more in (0, 1):
        use = sizes > 0 if not more else (sizes > 0) & (upper != own)
        r, v = rows[use[rows]], values[use[rows]]
        if not len(r):
            continue
        b = (upper if more else own)[r].astype(np.uint64)
        parts = np.uint64(FIRST_BAND // 2) << b
        found = _split(r, v, b, parts)
        yield found
        few = (np.bincount(found[0], minlength=len(sizes)) <= sizes // 4)[r]
        if few.any():
            yield _split(r[few], v[few], b[few] | np.uint64(128), parts[few] * np.uint64(FINER))


def part_keys(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the parts each set joins on: of each layout, those that come first. late marks the cells whose parts come last."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for pr, key, bits in _layouts(rows, values, sizes):
        order = np.lexsort((key, -bits, late[_cell(key)], pr))
        pr, key = pr[order], key[order]
        take = np.arange(len(pr)) - np.searchsorted(pr, pr) <= sizes[pr] // 4
        found.append((pr[take], key[take]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, cls, sketch) of every row, and cells that many parts of a task are in: n is minus their number, cls the cell."""

    def run(batches):
        import pyarrow as pa

        forget()
        held = np.zeros(CELLS, np.int64)
        names = ["doc_id", "text_key", "n", "cls", "sketch"]
        for batch in batches:
            sizes, classes, sketches = [], [], []
            for _, n, rows, values in shingle_sets(batch.column("text")):
                size, cls = _classes(n, rows, values)
                new = np.zeros(n, bool)
                new[np.unique(cls, return_index=True)[1]] = True
                for _, key, _ in _layouts(rows[new[rows]], values[new[rows]], np.where(new, size, 0)):
                    np.add.at(held, _cell(key), 1)
                bits = np.bincount(rows * SKETCH_BITS + (mix(values, 10) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=n * SKETCH_BITS) & 1
                sizes.append(size)
                classes.append(cls.view(np.int64))
                sketches.append(np.packbits(bits.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64))
            words = np.concatenate(sketches).ravel() if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(sizes).astype(np.int64) if sizes else [], pa.int64()), pa.array(np.concatenate(classes) if classes else [], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (SKETCH_BITS // 64), pa.int32()), pa.array(words))],
                names=names,
            )
        full = np.flatnonzero(held >= CELL_LEAST + CELL_TIMES * held.mean())
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(-held[full]), pa.array(full), pa.nulls(len(full), pa.list_(pa.int64()))], names=names)

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n long, cls long, sketch array<long>")


def _key_blobs(docs: DataFrame, ranges: int, last: np.ndarray) -> DataFrame:
    """(spot, keys, index, classes): part keys of many documents, packed by range of the key.

    Within what one task gathers, equal sets count once, and a key that many of them share goes
    on in one of them, marked in its lowest bit; all are written aside (a negative spot) as
    members of that key, so that no key brings more than FEW rows a flush to its range.
    """

    def flush(keys, index, classes):
        import pyarrow as pa

        order = np.argsort(keys, kind="stable")
        keys, index = keys[order], index[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(keys)))
        many = np.repeat(counts > FEW, counts)
        marked = keys | (many & first).astype(np.uint64)
        aside = many
        spot = (keys >> np.uint64(17)) % np.uint64(ranges)
        rows = []
        if aside.any():
            rows.append((-1 - int(classes[0] % np.uint64(ranges)), keys[aside].tobytes(), index[aside].tobytes()))
        going = ~many | first
        order = np.argsort(spot[going], kind="stable")
        k, x, s = marked[going][order], index[going][order], spot[going][order]
        cuts = np.searchsorted(s, np.arange(ranges + 1))
        rows += [(i, k[a:b].tobytes(), x[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        out = []
        for i, kk, xx in rows:  # only the classes that a row needs
            used, place = np.unique(np.frombuffer(xx, np.uint16), return_inverse=True)
            out.append((i, kk, place.astype(np.uint16).tobytes(), classes[used].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["spot", "keys", "index", "classes"])

    def run(batches):
        forget()
        late = np.zeros(CELLS, bool)
        late[last] = True
        seen: dict[int, int] = {}
        keys, index, size = [], [], 0
        for batch in batches:
            for _, n, rows, values in shingle_sets(batch.column("text")):
                sizes, cls = _classes(n, rows, values)
                new = np.zeros(n, bool)
                slot = np.zeros(n, np.uint16)
                for r, c in enumerate(cls.tolist()):
                    if c and c not in seen:
                        new[r], slot[r], seen[c] = True, len(seen), len(seen)
                pr, key = part_keys(rows[new[rows]], values[new[rows]], np.where(new, sizes, 0), late)
                keys.append(key)
                index.append(slot[pr])
                size += len(pr)
                if size > FLUSH_BYTES // 10 or len(seen) > FLUSH_CLASSES:
                    yield flush(np.concatenate(keys), np.concatenate(index), np.array(list(seen), np.uint64))
                    seen, keys, index, size = {}, [], [], 0
        if keys:
            yield flush(np.concatenate(keys), np.concatenate(index), np.array(list(seen), np.uint64))

    return docs.select("text").mapInArrow(run, "spot int, keys binary, index binary, classes binary")


def _unpack(table) -> tuple[np.ndarray, np.ndarray]:
    keys, classes = [], []
    for k, x, c in zip(*[table.column(n).to_pylist() for n in ("keys", "index", "classes")], strict=True):
        keys.append(np.frombuffer(k, np.uint64))
        classes.append(np.frombuffer(c, np.uint64)[np.frombuffer(x, np.uint16)])
    return (np.concatenate(keys), np.concatenate(classes)) if keys else (np.zeros(0, np.uint64),) * 2


def _pairs(members, cls):
    """Pairs of neighbours in runs of equal members, runs of at most FEW."""
    out = []
    for step in range(1, FEW):
        same = np.flatnonzero(members[step:] == members[:-step])
        if not len(same):
            break
        a, b = cls[same], cls[same + step]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


def _meet(table):
    """Of one range: (kind 0) pairs of classes that share a part, (kind 1) members of crowded parts."""
    import pyarrow as pa

    marked, cls = _unpack(table)
    keys = marked >> np.uint64(1)
    order = np.lexsort((cls, keys))
    marked, keys, cls = marked[order], keys[order], cls[order]
    crowd_key = keys[(marked & np.uint64(1)) == 1]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
    keys, cls = keys[fresh], cls[fresh]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    counts = np.diff(np.append(np.flatnonzero(first), len(keys)))
    many = np.repeat(counts > FEW, counts)
    if len(crowd_key):
        many |= np.isin(keys, crowd_key)
    pairs = _pairs(keys[~many], cls[~many])
    kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(int(many.sum()), np.int32)])
    a, b = np.concatenate([pairs[:, 0], keys[many]]), np.concatenate([pairs[:, 1], cls[many]])
    return pa.table([pa.array(kind), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])


def _thin(table):
    """Of part of one range: (kind 1) members of parts that are crowded by now, and all other rows with one of each crowded part, marked."""
    import pyarrow as pa

    marked, cls = _unpack(table)
    keys = marked >> np.uint64(1)
    order = np.lexsort((cls, keys))
    marked, keys, cls = marked[order], keys[order], cls[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]))
    first = np.append(True, keys[1:] != keys[:-1])
    run = np.cumsum(first) - 1
    crowded = (np.bincount(run, weights=fresh) > FEW) | (np.bincount(run, weights=marked & np.uint64(1)) > 0)
    told = fresh & crowded[run]
    keep = (fresh & ~crowded[run]) | (first & crowded[run])
    k, c = (keys << np.uint64(1) | crowded[run].astype(np.uint64))[keep], cls[keep]
    spot = table.column("spot")[0].as_py()
    rows = [(spot, k[i : i + FLUSH_CLASSES].tobytes(), np.arange(len(k[i : i + FLUSH_CLASSES]), dtype=np.uint16).tobytes(), c[i : i + FLUSH_CLASSES].tobytes()) for i in range(0, len(k), FLUSH_CLASSES)]
    kept = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["spot", "keys", "index", "classes"])
    return pa.table([pa.array(np.ones(int(told.sum()), np.int32)), pa.array(keys[told].view(np.int64)), pa.array(cls[told].view(np.int64))], names=["kind", "a", "b"]), kept


def _members(table):
    """Of rows written aside: (kind 1) members of crowded parts."""
    import pyarrow as pa

    keys, cls = _unpack(table)
    return pa.table([pa.array(np.ones(len(keys), np.int32)), pa.array((keys >> np.uint64(1)).view(np.int64)), pa.array(cls.view(np.int64))], names=["kind", "a", "b"])


def _verify(rows: DataFrame) -> DataFrame:
    """Of (a, b, text_a, text_b) the pairs (a, b) whose sets are linked."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, sides, right = batch.num_rows, [], np.ones(batch.num_rows, bool)
                for name, side in (("text_a", "a"), ("text_b", "b")):
                    wanted = batch.column(side).to_numpy().view(np.uint64)
                    for i, k, rows, values in shingle_sets(batch.column(name)):
                        right[i : i + k] &= _classes(k, rows, values)[1] == wanted[i : i + k]  # not another text of that doc_id
                        sides.append((i + rows, values))
                r = np.concatenate([x for x, _ in sides])
                v = np.concatenate([x for _, x in sides])
                total = np.bincount(r, minlength=n)
                order = np.lexsort((v, r))
                r, v = r[order], v[order]
                same = np.bincount(r[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])], minlength=n)
                ok = pa.array(right & (total > 0) & (100 * same >= 80 * (total - same)))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _hamming_ok():
    word = lambda i: F.bit_count(F.get(F.col("sketch_a"), F.lit(i)).bitwiseXOR(F.get(F.col("sketch_b"), F.lit(i))))
    apart = sum((word(i) for i in range(1, SKETCH_BITS // 64)), word(0))  # spelt out, so that it is compiled
    near_size = (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    return near_size & (9 * apart <= F.col("n_a") + F.col("n_b"))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, component_id) of every row; class_id is the least doc_id of an equal set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = checkpoint(_sets(docs))
    ranges = ranges_of(docs)
    classes = checkpoint(sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")).where("rep IS NOT NULL"))

    info = lambda side: classes.select(F.col("cls").alias(side), F.col("rep").alias(f"rep_{side}"), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))

    def stars(crowded: DataFrame) -> DataFrame:
        """Pairs of each crowded part's members with its centre."""
        support = crowded.groupBy("cls").agg(F.count(F.lit(1)).alias("support"))
        centre = crowded.join(support, "cls").groupBy("part").agg(F.max(F.struct(F.col("support"), (-F.col("cls")).alias("least"))).alias("top")).select("part", (-F.col("top.least")).alias("centre"))
        return crowded.join(centre, "part").where("cls <> centre").select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b"))

    def near(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes, those within the bounds, with their representatives."""
        return checkpoint(pairs.join(info("a"), "a").join(info("b"), "b").where(_hamming_ok()).select("a", "b", "rep_a", "rep_b"))

    def linked(close: DataFrame) -> DataFrame:
        """Of near() pairs, the linked ones as (u, v) of their representatives; one text of each class is moved for it."""
        compared = close.select(F.col("rep_a").alias("doc_id"), F.col("a").alias("cls")).unionByName(close.select(F.col("rep_b").alias("doc_id"), F.col("b").alias("cls"))).distinct()
        texts = shared_table(docs.join(compared, "doc_id").select("cls", "text"), "compared-texts")
        both = close.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        return checkpoint(_verify(both).distinct().join(close, ["a", "b"]).select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")))

    def still_open(crowded: DataFrame, found: DataFrame) -> DataFrame:
        """(part, cls, component): members of crowded parts that several components share."""
        label = classes.select("cls", "rep").join(found, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
        labelled = crowded.join(label, "cls")
        parts = labelled.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("part")
        return checkpoint(labelled.join(parts, "part").select("part", "cls", "component"))

    full = sets.where("n < 0").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") <= -CELL_LEAST * FEW).orderBy("n", "cls").limit(MOST_LAST)
    last = np.array([r.cls for r in full.collect()], np.int64)
    met = checkpoint(by_spot(_key_blobs(docs, ranges, last), ranges).mapInArrow(in_ranges(_meet, _members, _thin), "kind int, a long, b long"))
    crowded = checkpoint(met.where("kind = 1").select(F.col("a").alias("part"), F.col("b").alias("cls")).distinct())
    found = checkpoint(components(linked(near(met.where("kind = 0").select("a", "b").unionByName(stars(crowded)).distinct()))))
    rest = still_open(crowded, found)
    if not rest.isEmpty():
        left = rest.select("part", F.col("cls").alias("a"), F.col("component").alias("c_a")).join(info("a"), "a")
        right = rest.select(F.col("part").alias("p_b"), F.col("cls").alias("b"), F.col("component").alias("c_b")).join(info("b"), "b")
        across = left.join(right, (F.col("part") == F.col("p_b")) & (F.col("c_a") < F.col("c_b")) & _hamming_ok())
        found = joined(found, linked(near(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())))
    by_class = classes.select("cls", "rep").join(found, F.col("rep") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "rep").alias("component"))
    out = sets.where("n >= 0").select("doc_id", "text_key", "n", "cls").join(by_class, "cls", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
