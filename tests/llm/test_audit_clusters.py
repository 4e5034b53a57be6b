"""The filter audit and the clustering against brute force: odd rows, ties, repeats, sizes beyond a long."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import drake_kmeans, filter_audit
from tests.llm import brute
from tests.llm.test_edges import clashing, empty, odd, odd_rows, prose  # noqa: F401

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int"


def audited(docs, labels):
    rows = filter_audit.audit(docs, filter_audit.corpus_filters(F.col("text")), F.col("lang"), {"good": labels.where("quality = 1"), "toxic": labels.where("toxic = 1")}).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_of_odd_rows(spark, clashing, empty):  # noqa: F811
    labels = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, 1), (8, 1, None), (9, 1, 1), (12, 1, 0), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame(labels, LABELS)
    want = brute.filter_audit([(i, t, lang) for i, t, lang, _, _ in odd_rows()], labels)
    assert audited(clashing, marks) == want and len(want) == 600 * len({lang for _, _, lang, _, _ in odd_rows()})
    assert audited(empty, marks) == {}
    nothing = audited(clashing, spark.createDataFrame([], LABELS))
    assert all(v[4] == v[5] == 0 for v in nothing.values())


def test_audit_of_every_mask_copies_across_parts_and_a_hot_text(spark):
    r = random.Random(5)
    few, many = prose(1, 150), prose(2, 400)
    texts = [few, many, "a b " * 300, "A B " * 300, many + " #", few.upper(), "", None, "x | y", many.upper() + "|"]
    docs = [(r.randint(0, 250), r.choice(texts), r.choice(["en", "de", "", None])) for _ in range(500)] + [(1000 + i, many, "en") for i in range(300)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 1300, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    assert audited(df, spark.createDataFrame(labels, LABELS)) == brute.filter_audit(docs, labels)


def clustered(spark, vectors, kind="float", **more):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("clash")).repartition(3)
    return Counter(tuple(r) for r in drake_kmeans.cluster(df, **more).collect())


def as_floats(vectors):
    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]


def test_clusters_of_odd_vectors(spark):
    r = random.Random(3)
    grid = [(i, [float(r.randint(-2, 2)) / 64 for _ in range(64)]) for i in range(120)]
    odd_ones = [(None, [0.5] * 64), (7, [0.5] * 64), (7, [0.25] * 64), (7, [0.25] * 64), (200, None), (201, [0.1] * 63), (202, [None] + [0.1] * 63), (203, [float("nan")] + [0.1] * 63), (204, [float("inf")] + [0.1] * 63), (205, []), (206, [-1e-9] * 64)]
    vectors = as_floats(grid + odd_ones)
    assert clustered(spark, vectors) == brute.clusters(vectors)
    assert not clustered(spark, [(1, [0.5] * 64)][:0])
    one = as_floats([(i, [float(i)] * 64) for i in range(3)])
    assert clustered(spark, one) == brute.clusters(one)
    assert clustered(spark, one, k=1) == brute.clusters(one, k=1)


def test_clusters_of_many_equal_vectors(spark):
    vectors = as_floats([(i, [0.125] * 64) for i in range(300)] + [(1000 + i, [0.125 + (i + j) % 3 / 256 for j in range(64)]) for i in range(60)])
    assert clustered(spark, vectors) == brute.clusters(vectors)


@pytest.mark.parametrize(("kind", "sizes"), [("float", [1e3, 1e6, 3e38]), ("double", [1.0, 2.0**19, 2.0**23, 1e18, 1e308])])
def test_clusters_of_any_size_are_exact(spark, kind, sizes):
    r = random.Random(8)
    vectors = [(i, [r.uniform(-1, 1) * r.choice(sizes) if i % 3 else r.uniform(-1, 1) for _ in range(8)]) for i in range(70)]
    vectors += [(100 + i, [sizes[-1] * (1 - i / 1000)] * 8) for i in range(12)]
    vectors = as_floats(vectors) if kind == "float" else vectors
    assert clustered(spark, vectors, kind, k=12, dimensions=8) == brute.clusters(vectors, k=12, dimensions=8)


def test_bounds_spare_distances_and_narrow(monkeypatch):
    """Well separated groups: after the first round no vector is compared with all centroids again."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = np.concatenate([c + rng.integers(-20, 20, (50, 8)) for c in centres])
    now = [list(map(int, c)) for c in centres]
    start = drake_kmeans.Centroids(now)
    bounds = drake_kmeans.scanned(start.distances(x, (x * x).sum(1)), 4)
    moved = [[v + 3 for v in row] for row in now]
    after = drake_kmeans.Centroids(moved, now)
    asked = []
    monkeypatch.setattr(drake_kmeans.Centroids, "distances", lambda self, x, norms: asked.append(len(x)))
    found, depth = drake_kmeans.reassigned(x, bounds, after, 2)
    assert not asked and depth == 0 and found.near.shape == (len(x), 2) and (found.cluster == bounds.cluster).all()
