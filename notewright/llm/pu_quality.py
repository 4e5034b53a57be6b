"""Quality classifier by positive-unlabelled learning.

A small network over style features is trained to minimise the non-negative unbiased risk
    prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)])
from trusted positives, unlabelled texts and a class prior, then its output is put on a
probability scale (see fit). Features come from the whole text alone: frequencies of
character-class trigrams, hashed, and a few ratios over words.

Defined results: null and empty texts get the score of the all-zero feature row, a number from
0 to 1 like any other; repeated rows get equal scores; an empty table gives an empty one; without
a positive or an unlabelled row every score is the prior (0.5 if that is unknown too). Existing
columns `score` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.arrowtext import Words, groups, mix, text_bytes
from notewright.llm.common import append_arrow

#: Bound of the training sample: so many positives, labelled rows for the scale, and unlabelled rows.
SAMPLE_ROWS = 8192
TRIGRAM_BINS, RATIOS, HIDDEN = 256, 8, 24
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 512, 3e-3, 1e-4, 11

#: Class of each byte. 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 beyond ASCII, 6 control, 7 brackets and quotes, then single marks.
_CLASS = np.full(256, 6, np.int64)
_CLASS[[32, 9]] = 0
_CLASS[[10, 13]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5
for _i, _marks in enumerate((b"()[]{}<>\"'`", b".", b",", b"!?", b":;", b"-_/\\", b"|", b"#*$%&@~^=+")):
    _CLASS[list(_marks)] = 7 + _i
_BIN = (mix(np.arange(4096, dtype=np.uint64), 5) % np.uint64(TRIGRAM_BINS)).astype(np.int64)


def features(column) -> np.ndarray:
    """One row of TRIGRAM_BINS + RATIOS numbers for each text of an Arrow column."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, TRIGRAM_BINS + RATIOS), np.float32)
    for i, j in groups(offsets):
        raw, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        sizes = np.diff(ends)
        if not len(raw):
            continue
        doc = np.repeat(np.arange(n), sizes)
        kind = _CLASS[raw]
        if len(raw) > 2:
            inside = doc[2:] == doc[:-2]
            code = _BIN[(kind[:-2] << 8) | (kind[1:-1] << 4) | kind[2:]]
            counts = np.bincount((doc[2:] * TRIGRAM_BINS + code)[inside], minlength=n * TRIGRAM_BINS).reshape(n, TRIGRAM_BINS)
            out[i:j, :TRIGRAM_BINS] = np.log1p(1000.0 * counts / np.maximum(1, sizes)[:, None])
        w = Words(raw, ends)
        words = np.diff(w.first)
        of = np.repeat(np.arange(n), words)
        per = lambda x, of=of, n=n: np.bincount(of, weights=x, minlength=n)
        many = np.maximum(1, words)
        order = np.lexsort((w.hashes, of))
        fresh = np.ones(len(of), bool)
        fresh[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        again = np.zeros(len(of), bool)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
        length = w.ends - w.starts
        capital = (raw[w.starts] >= 65) & (raw[w.starts] <= 90)
        out[i:j, TRIGRAM_BINS:] = np.stack(
            [np.log1p(words), np.log1p(sizes), per(length) / many, np.sqrt(per(length.astype(float) ** 2) / many), np.bincount(of, weights=fresh[np.argsort(order, kind="stable")], minlength=n) / many, per(again) / many, per(capital) / many, per(length > 20) / many], axis=1
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]  # w1, b1, w2, b2
    scale: tuple[float, float]  # slope and offset of the logit
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.layers):
            return np.full(len(x), self.prior)
        z = self.scale[0] * _forward((x - self.mean) / self.spread, self.layers)[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(x, layers):
    w1, b1, w2, b2 = layers
    hidden = np.maximum(0, x @ w1 + b1)
    return hidden @ w2 + b2, hidden


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Layers that minimise the non-negative risk with the logistic loss, by Adam.

    Where the estimate of the negative risk in a batch falls below zero, the step climbs back
    out of it instead, as the non-negative estimator prescribes.
    """
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    batches = max(1, len(unlabelled) // BATCH)
    for _ in range(EPOCHS):
        pos, unl = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for p, u in zip(pos, unl, strict=True):
            if not len(p):
                p = rng.integers(0, len(positive), 16)
            x = np.concatenate([positive[p], unlabelled[u]])
            z, hidden = _forward(x, layers)
            zp, zu = z[: len(p)], z[len(p) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad_p, grad_u = prior * -_sigmoid(-zp) / len(p), np.zeros(len(u))
            if negative >= 0:
                grad_p, grad_u = grad_p - prior * _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
            else:
                grad_p, grad_u = prior * _sigmoid(zp) / len(p), -_sigmoid(zu) / len(u)
            g = np.concatenate([grad_p, grad_u])
            gh = np.outer(g, layers[2]) * (hidden > 0)
            grads = [x.T @ gh + DECAY * layers[0], gh.sum(0), hidden.T @ g + DECAY * layers[2], g.sum()]
            t += 1
            for i, gr in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr * gr
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def estimate_prior(labelled: DataFrame, quality: str = "quality") -> float:
    """The share of positives among the labelled rows, kept off 0 and 1; 0.5 without any."""
    share = labelled.where(F.col(quality).isNotNull()).agg(F.avg((F.col(quality) == 1).cast("double"))).first()[0]
    return 0.5 if share is None else min(0.99, max(0.01, float(share)))


def _scale(logits: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on logits (Newton's method, slightly ridged)."""
    if not len(label) or label.min() == label.max():
        return 1.0, 0.0
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    x, beta = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        beta = beta - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (beta - [1, 0]))
    return max(1e-3, float(beta[0])), float(beta[1])


def sample_ids(rows: DataFrame, key: str = "doc_id", most: int = SAMPLE_ROWS) -> DataFrame:
    """At most `most` ids: the least hash in each of so many hash buckets. No sort, no seed of time."""
    h = F.xxhash64(key)
    return rows.where(F.col(key).isNotNull()).groupBy(F.pmod(h, F.lit(most)).alias("bucket")).agg(F.min_by(key, F.xxhash64(h)).alias(key)).select(key)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> QualityModel:
    """Train on a bounded sample of docs and of the labels that belong to them.

    Positives are labelled rows of quality 1, unlabelled rows are any of docs; the labelled
    sample, both classes, serves for the prior and for the two numbers that turn the network's
    output into a probability.
    """
    prior = estimate_prior(labels)
    marked = sample_ids(labels.where("quality IS NOT NULL")).join(labels.select("doc_id", "quality"), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    web = sample_ids(docs.select("doc_id")).withColumn("web", F.lit(1))
    wanted = web.join(marked, "doc_id", "full")  # at most 2 * SAMPLE_ROWS rows
    rows = docs.select("doc_id", text).join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch, [pa.array([r.tobytes() for r in features(batch.column(batch.schema.get_field_index(text)))], pa.binary())]

    found = append_arrow(rows, run, "x binary").select("doc_id", "web", "quality", "x").toArrow()
    found = found.take(np.argsort(found.column("doc_id").to_numpy()))
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(found.num_rows, -1).astype(float) if found.num_rows else np.zeros((0, TRIGRAM_BINS + RATIOS))
    quality = found.column("quality").to_numpy(zero_copy_only=False).astype(float)
    web_row = found.column("web").to_numpy(zero_copy_only=False).astype(float) == 1
    good, known = quality == 1, ~np.isnan(quality)
    if not good.any() or not web_row.any():
        return QualityModel(np.zeros(1), np.ones(1), (), (1.0, 0.0), prior)
    mean, spread = x[web_row].mean(0), x[web_row].std(0) + 0.05
    z = (x - mean) / spread
    layers = train_nnpu(z[good], z[web_row], prior)
    return QualityModel(mean, spread, layers, _scale(_forward(z[known], layers)[0], quality[known]), prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with `score`; reads nothing but the text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch, [pa.array(model.score(features(batch.column(batch.schema.get_field_index(text))).astype(float)), pa.float64())]

    return append_arrow(docs, run, "score double")
