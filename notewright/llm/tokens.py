"""Token ids of whole texts by a public tokenizer file, with the repeated work taken out.

Encoding by `tokenizers` word by word equals encoding the text wherever white space always
separates pre-tokens, so each worker keeps a bounded table of the words it has met and encodes
only new ones, all new words of a batch in one call. Plain words skip the normaliser; words of
uncommon scripts, and texts with control separators or with one of the tokenizer's added tokens,
go through the tokenizer unchanged.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Words a worker remembers before it starts its table anew.
MOST_WORDS = 1 << 20
#: What Python's split() takes for white space and a tokenizer's \\s does not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Scripts whose letters, digits and case every Unicode version agrees on: up to Latin Extended-A.
_COMMON = re.compile("[\x00-ſ]*\\Z")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids by a tokenizers JSON file of the kind: normalise, split at a pattern, byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else [spec["pre_tokenizer"]]
        patterns = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        added = spec.get("added_tokens") or []
        self.marks = [t["content"] for t in added if not t["normalized"]]
        self.normal_marks = [unicodedata.normalize("NFC", t["content"]).lower() for t in added if t["normalized"]]
        self.by_word = bool(suffix) and len(patterns) == 1 and [s["type"] for s in steps] == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"]
        self.kind = np.dtype(np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32)
        self.words: dict[str, bytes] = {}
        if self.by_word:
            import regex

            self.split = regex.compile(patterns[0])
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = None
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = _byte_letters()
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)  # ids that end a piece
            self.ends[[i for token, i in self.whole.get_vocab().items() if token.endswith(suffix)]] = True

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words in the table."""
        parts: list[tuple[str, list[str]]] = []
        for w in words:
            stem = w.rstrip(".,")
            if stem.isascii() and stem.isalpha():
                parts.append((w, [stem, w[len(stem) :]] if len(stem) < len(w) else [stem]))
            elif _COMMON.match(w):  # composed already, and no white space within
                parts.append((w, self.split.findall(w)))
            else:
                self.words[w] = self._bytes(self.whole.encode(w, add_special_tokens=False).ids)
        unique = list({p for _, ps in parts for p in ps})
        shown = [p if p.isascii() and p.isprintable() else "".join(self.letters[b] for b in p.encode()) for p in unique]
        found: dict[str, bytes] = {}
        runs = [slice(i, i + 256) for i in range(0, len(unique), 256)]
        for run, e in zip(runs, self.pieces.encode_batch_fast([" ".join(shown[r]) for r in runs], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, self.kind)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()]
            raw = ids.tobytes()
            found.update(zip(unique[run], [raw[x:y] for x, y in zip(cuts, cuts[1:])], strict=True))
        for w, ps in parts:
            self.words[w] = found[ps[0]] if len(ps) == 1 else b"".join(map(found.__getitem__, ps))

    def _split(self, text: str) -> list[str]:
        """Lower-case words; none where the text must be encoded whole."""
        if not self.by_word or any(c in text for c in _ODD_SPACE) or any(m in text for m in self.marks):
            return []
        if self.normal_marks and any(m in unicodedata.normalize("NFC", text).lower() for m in self.normal_marks):
            return []
        if text.isascii() or _COMMON.match(text):
            return text.lower().split()
        return [w.lower() if _COMMON.match(w) else w for w in text.split()]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is an empty text."""
        split = [self._split(t) if t else [] for t in texts]
        met = set().union(*split)
        new = met.difference(self.words)  # asks the table for each word met; the other way round it would walk the table
        if len(self.words) + len(new) > MOST_WORDS:
            self.words, new = {}, met
        self._learn(list(new))
        out = []
        for t, ws in zip(texts, split, strict=True):
            if ws or not t:
                out.append(np.frombuffer(b"".join(map(self.words.__getitem__, ws)), self.kind))
            else:  # another kind of tokenizer, control separators, or white space alone
                out.append(np.asarray(self.whole.encode(t, add_special_tokens=False).ids, self.kind))
        return out


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker and file."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]


def forget() -> None:
    """Give what a worker's tokenizers and their tables of words hold back to the system; for tasks of
    other operators that the worker is lent to."""
    import ctypes
    import gc

    import pyarrow as pa

    _made.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
    if trim is not None:
        trim(0)
