"""The positive-unlabelled training against plain Python: the risk from its definition, its slope by differences, Adam by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest

from notewright.llm import pu_quality


def output(layers, row):
    w1, b1, w2, b2 = layers
    hidden = [max(0.0, sum(x * w for x, w in zip(row, column, strict=True)) + b) for column, b in zip(zip(*w1, strict=True), b1, strict=True)]
    return sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2


def log_loss(z):
    """Of an output z for the positive class."""
    return math.log1p(math.exp(-z))


def objective(layers, positive, unlabelled, prior, decay, climbing):
    """The unbiased risk with its decay; while its negative part is below zero, minus that part alone."""
    p, u = [output(layers, x) for x in positive], [output(layers, x) for x in unlabelled]
    mean = lambda xs: sum(xs) / len(xs)
    negative = mean([log_loss(-z) for z in u]) - prior * mean([log_loss(-z) for z in p])
    ridge = decay / 2 * (sum(w * w for row in layers[0] for w in row) + sum(w * w for w in layers[2]))
    return (-negative if climbing else prior * mean([log_loss(z) for z in p]) + negative) + ridge, negative


def flat(layers):
    w1, b1, w2, b2 = layers
    return [w for row in w1 for w in row] + list(b1) + list(w2) + [b2]


def shaped(xs, d, h):
    return [xs[i * h : (i + 1) * h] for i in range(d)], xs[d * h : d * h + h], xs[d * h + h : d * h + 2 * h], xs[-1]


def by_hand(start, positive, unlabelled, prior, steps, rate, decay, d, h):
    xs, first, second, parts = flat(start), [0.0] * len(flat(start)), [0.0] * len(flat(start)), []
    for t in range(1, steps + 1):
        parts.append(objective(shaped(xs, d, h), positive, unlabelled, prior, decay, False)[1])
        climbing = parts[-1] < 0
        at = lambda i, e, xs=xs, c=climbing: objective(shaped([x + e * (j == i) for j, x in enumerate(xs)], d, h), positive, unlabelled, prior, decay, c)[0]
        slope = [(at(i, 1e-6) - at(i, -1e-6)) / 2e-6 for i in range(len(xs))]
        first = [0.9 * m + 0.1 * g for m, g in zip(first, slope, strict=True)]
        second = [0.999 * v + 0.001 * g * g for v, g in zip(second, slope, strict=True)]
        xs = [x - rate * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8) for x, m, v in zip(xs, first, second, strict=True)]
    return xs, parts


@pytest.mark.parametrize(("prior", "climbs"), [(0.3, False), (0.97, True)])
def test_training_follows_the_risk(monkeypatch, prior, climbs):
    d, h, steps, rate, decay = 3, 2, 6, 0.02, 1e-4
    for name, value in (("HIDDEN", h), ("EPOCHS", steps), ("BATCH", 64), ("RATE", rate), ("DECAY", decay)):
        monkeypatch.setattr(pu_quality, name, value)
    rng = np.random.default_rng(3)
    # where the unlabelled rows look unlike the positives, a large prior makes the negative part fall below zero
    positive, unlabelled = rng.normal(0.5, 1, (9, d)), rng.normal(-2.5 if climbs else 0, 1, (20, d))
    got = pu_quality.train_nnpu(positive, unlabelled, prior, seed=5)
    draws = np.random.default_rng(5)
    start = draws.normal(0, np.sqrt(2 / d), (d, h)), np.zeros(h), draws.normal(0, np.sqrt(1 / h), h), np.zeros(())
    want, parts = by_hand([x.tolist() for x in start], positive.tolist(), unlabelled.tolist(), prior, steps, rate, decay, d, h)
    found = flat([np.asarray(x).tolist() for x in got])
    assert any(p < 0 for p in parts) == climbs
    assert max(abs(a - b) for a, b in zip(found, want, strict=True)) < 1e-4


def test_prior_is_the_share_of_positives(spark):
    rows = lambda qs: spark.createDataFrame(list(enumerate(qs)), "doc_id long, quality int")
    assert abs(pu_quality.estimate_prior(rows([1, 1, 0, None, 0, 1])) - 0.6) < 1e-12
    assert pu_quality.estimate_prior(rows([None])) == 0.5 and pu_quality.estimate_prior(rows([1, 1])) == 0.99
