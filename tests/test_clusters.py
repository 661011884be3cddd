"""Cluster figures from sums against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from corpusmill.operators import vector


def test_silhouette_against_pairs(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.random() + 3 * (k % 3), rnd.random()], k % 3) for k in range(30)] + [(30, [9.0, 9.0], 7), (31, [1.0, 1.0], None), (32, None, 1)]
    out = {r.id: r.silhouette for r in vector.silhouette(spark.createDataFrame(rows, "id int, embedding array<double>, cluster int")).collect()}
    full = [r for r in rows if r[1] and r[2] is not None]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    for k, x, c in full:
        means = {o: [square(x, y) for j, y, d in full if d == o and j != k] for o in {r[2] for r in full}}
        own = means.pop(c)
        want = 0.0 if not own else (lambda a, b: (b - a) / max(a, b))(sum(own) / len(own), min(sum(m) / len(m) for m in means.values()))
        assert math.isclose(out[k], want, abs_tol=1e-9)
    assert len(out) == len(rows) and out[31] is None and out[32] is None


def test_cluster_edges(spark):
    schema = "id int, embedding array<double>, cluster int"
    one = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0)], schema)
    assert [r.silhouette for r in vector.silhouette(one).collect()] == [None, None]
    row = vector.cluster_quality(one).first()
    assert (row.n_clusters, row.n, row.inside, row.between, row.estimate) == (1, 2, 0.0, 0.0, 0.0)
    two = spark.createDataFrame([(1, [0.0], 0), (2, [2.0], 0), (3, [8.0], 1), (4, [12.0], 1), (5, [14.0], 2), (6, [14.0], 2)], schema)
    row = vector.cluster_quality(two).first()
    assert (row.n_clusters, row.inside) == (3, 0.0) and math.isclose(row.between, (9 + 13 + 4) / 3) and row.estimate == 1.0
    assert vector.silhouette(one.limit(0)).count() == 0 and vector.cluster_quality(one.limit(0)).first().n_clusters == 0
    with pytest.raises(ValueError, match="limit"):
        vector.silhouette(two, most=2)
