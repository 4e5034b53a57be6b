"""Language identification by compression.

One zstandard raw-content dictionary per language is cut from a bounded sample of labelled
texts. A text goes to the language whose dictionary encodes it in the fewest bytes; where the
runner-up is almost as short the decision is marked as rejected.

Defined results: a null text, or one without a letter, gives `und`, score 0 and rejected.
Languages that tie even after a finer second encoding are taken in alphabetical order.
Repeated rows get equal answers; an empty table gives an empty one; with no labelled row at
all every text gives `und`. Existing columns named like the new ones are replaced.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import append_arrow
from notewright.llm.tokens import forget

#: Bound of the labelled sample: one snippet of this many code points from each of so many rows a language.
SAMPLE_ROWS, SAMPLE_CHARS = 768, 80
#: Of a snippet as it is compared so many bytes count, so that a dictionary holds all of them in 64 KiB.
SNIPPET_BYTES = 84
BLOCK_BYTES = 8192
#: Below this relative gap between the two shortest encodings a decision is rejected.
MIN_MARGIN = 0.002
UNDETERMINED = "und"

_ONLY_LETTERS = {ord(c): " " for c in map(chr, range(128)) if c not in string.ascii_letters}


def _plain(text: str) -> str:
    """Lower case, ASCII letters and whatever lies beyond ASCII, single spaces."""
    return " ".join(text.lower().translate(_ONLY_LETTERS).split())


@dataclass(frozen=True)
class LanguageModel:
    """A raw-content dictionary for each language."""

    dictionaries: dict[str, bytes]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Dictionaries from rows whose language is known.

    Each language's rows are dealt by hash to sample_rows buckets and each bucket keeps the row
    of the least hash, so the sample is bounded, reproducible and taken without a sort; of a
    row it holds one snippet from a position that its hash fixes.
    """
    h = F.xxhash64(F.col(text))
    at = 1 + F.pmod(F.shiftrightunsigned(h, 20), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS))
    snippets = (
        labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).alias("lang"), F.pmod(h, F.lit(sample_rows)).alias("bucket"), F.substring(F.col(text), at.cast("int"), F.lit(SAMPLE_CHARS)).alias("snippet"), F.xxhash64(h, F.lit(1)).alias("rank"))
        .groupBy("lang", "bucket")
        .agg(F.min_by("snippet", "rank").alias("snippet"))
    )
    found: dict[str, list[bytes]] = {}
    for row in sorted(snippets.collect()):  # at most sample_rows short snippets a language
        found.setdefault(row.lang, []).append(_plain(row.snippet).encode()[:SNIPPET_BYTES])
    return LanguageModel({k: b" ".join(v) for k, v in sorted(found.items())})


def _encoders(model: LanguageModel, fine: bool):
    import zstandard as zstd

    strategy = {"strategy": zstd.STRATEGY_BTULTRA2, "min_match": 3, "search_log": 6} if fine else {"strategy": zstd.STRATEGY_GREEDY, "min_match": 4, "search_log": 2}
    params = zstd.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, write_content_size=False, **strategy)
    found = {}
    for name, raw in model.dictionaries.items():
        if len(raw) < 8:  # too short to serve as a dictionary
            found[name] = zstd.ZstdCompressor(compression_params=params)
            continue
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        found[name] = zstd.ZstdCompressor(dict_data=d, compression_params=params)
    return found


def _sizes(raw: bytes, encoders) -> dict[str, int]:
    return {k: sum(len(e.compress(raw[i : i + BLOCK_BYTES])) for i in range(0, len(raw), BLOCK_BYTES)) for k, e in encoders.items()}


def classify(text: str | None, coarse, fine) -> tuple[str, float, float]:
    """Language, score (a softmax over encoded bytes) and relative margin of one text."""
    if not text or not coarse or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0
    raw = _plain(text).encode()
    sizes = _sizes(raw, coarse)
    best, *rest = sorted(sizes, key=lambda k: (sizes[k], k))
    if rest and sizes[best] == sizes[rest[0]]:
        sizes = _sizes(raw, fine)
        best, *rest = sorted(sizes, key=lambda k: (sizes[k], k))
    score = 1 / sum(math.exp(min(0.0, sizes[best] - x)) for x in sizes.values())
    return best, score, (sizes[rest[0]] - sizes[best]) / sizes[best] if rest else 1.0


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score, margin and rejected; reads nothing but the text."""

    def run(batches):
        import pyarrow as pa

        forget()  # a worker that has packed before may be lent to this
        coarse, fine = _encoders(model, False), _encoders(model, True)
        for batch in batches:
            found = [classify(t.as_py(), coarse, fine) for t in batch.column(batch.schema.get_field_index(text))]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            yield batch, [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([k == UNDETERMINED or m < min_margin for k, m in zip(lang, margin, strict=True)], pa.bool_())]

    return append_arrow(docs, run, "lang_pred string, score double, margin double, rejected boolean")
