"""Plain Python versions of what the operators promise, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def substring_words(docs, window=35):
    """[(doc_id, n_words, n_removed, kept_sha256)] of [(doc_id, text)]."""
    words = [WORD.findall(t or "") for _, t in docs]
    prints = [[hashlib.md5(" ".join(w[i : i + window]).encode()).digest() for i in range(len(w) - window + 1)] for w in words]
    seen = Counter(p for ps in prints for p in ps)
    out = []
    for (doc_id, _), w, ps in zip(docs, words, prints, strict=True):
        gone = [False] * len(w)
        for i, p in enumerate(ps):
            if seen[p] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def substring_bytes(docs, window=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]; a null doc_id is larger than all others."""
    key = lambda d: (d is None, d or 0)
    first: dict[bytes, tuple] = {}
    raws = [(doc_id, (t or "").encode()) for doc_id, t in docs]
    for doc_id, raw in raws:
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            if s not in first or key(doc_id) < first[s]:
                first[s] = key(doc_id)
    out = []
    for doc_id, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < key(doc_id):
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


def shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(docs, percent=80):
    """[(doc_id, n_shingles, component_id)] of documents with distinct ids."""
    sets = [(d, shingles(t)) for d, t in docs]
    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for i, (_, s) in enumerate(sets):
        mine = Counter(j for x in s for j in by[x] if j < i)
        shared.update({(j, i): n for j, n in mine.items()})
    groups = Sets()
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i][1]) + len(sets[j][1]) - n):
            groups.join(sets[i][0], sets[j][0])
    return [(d, len(s), groups.root(d)) for d, s in sets]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
BASE = [("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def base_spans(text):
    """[(start, kind number, end)] by start, then kind."""
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))


def secrets_row(doc_id, text):
    spans = base_spans(text)
    line = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
    return (doc_id, *[sum(1 for s in spans if s[1] == k) for k in range(3)], sha(line.encode()))


def quality_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


class KneserNey:
    """Modified Kneser-Ney over the symbols of sequences, by dictionaries, straight from its definition."""

    def __init__(self, sequences, order, symbols=257):
        self.order, self.uniform = order, 1 / symbols
        self.counts = {n: Counter() for n in range(1, order + 1)}
        for s in sequences:
            padded = ["<"] * (order - 1) + [*s, ">"]
            self.counts[order].update(tuple(padded[i : i + order]) for i in range(len(s) + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n].update(g[1:] for g in self.counts[n + 1])
        self.discount, self.contexts = {}, {}
        for n, counts in self.counts.items():
            c = Counter(counts.values())
            ds = (0.5, 1.0, 1.5)
            if all(c[i] for i in (1, 2, 3, 4)):
                y = c[1] / (c[1] + 2 * c[2])
                fitted = tuple(i - (i + 1) * y * c[i + 1] / c[i] for i in (1, 2, 3))
                ds = fitted if all(0 < d < i for i, d in enumerate(fitted, 1)) else ds
            self.discount[n] = ds
            self.contexts[n] = defaultdict(list)
            for g, x in counts.items():
                self.contexts[n][g[:-1]].append(x)

    def p(self, gram):
        n = len(gram)
        if not n:
            return self.uniform
        seen = self.contexts[n].get(gram[:-1])
        if seen is None:
            return self.p(gram[1:])
        ds, total = self.discount[n], sum(seen)
        own = self.counts[n][gram]
        return (own - (ds[min(own, 3) - 1] if own else 0)) / total + sum(ds[min(x, 3) - 1] for x in seen) / total * self.p(gram[1:])

    def log_ppl(self, s):
        from math import log

        padded = ["<"] * (self.order - 1) + [*s, ">"]
        return -sum(log(self.p(tuple(padded[i : i + self.order]))) for i in range(len(s) + 1)) / (len(s) + 1)


def filter_audit(docs, labels):
    """Every order over every document; docs: (doc_id, text, lang), labels: (doc_id, quality, toxic). {(part, order, step): counts}"""
    from itertools import permutations

    good, toxic = ({d for d, *m in labels if d is not None and m[i] == 1} for i in (0, 1))
    least: dict = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in t for c in "#$%&*|") + "E" * (d is not None and d > least[t])
        parts[lang or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removed_by[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def clusters(vectors, k=40, rounds=5, dimensions=64):
    """Counter of (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of [(vec_id, vector)]."""
    from math import floor, isfinite

    most = (1 << 63) - 1
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and isfinite(x) for x in v)]
    ints = [[floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v] for _, v in kept]
    named = sorted((sha(f"2:{i}".encode()), v) for (i, _), v in zip(kept, ints, strict=True) if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for x in ints:
            groups[nearest(x)[1]].append(x)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else row for j, row in enumerate(centroids)]
    found = [nearest(x) for x in ints]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    names = [sha(",".join(map(str, c)).encode()) for c in centroids]
    return Counter((i, j, min(d, most), min(inertia[j], most), min(sum(inertia.values()), most), names[j]) for (i, _), (d, j) in zip(kept, found, strict=True))
