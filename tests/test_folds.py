"""Folds in blocks against a plain loop."""

from __future__ import annotations

import math
import random

import pytest

from corpusmill.operators import folds
from corpusmill.operators.metrics import Series

S = Series(["run"], ["step"])


def slow(values, least):
    best, at, out = None, None, []
    for k, v in enumerate(values):
        if v is not None and math.isfinite(v) and (best is None or v < best - least):
            best, at = v, k
        out.append((best, None if at is None else k - at, k))
    return out


def test_effect():
    assert folds.effect([5.0, 4.5, 4.0, 7.0, 1.0], range(5), 0.6) == ([5.0, 4.5, 4.0, 1.0], [1.0] * 4, [4] * 4)
    assert folds.effect([5.0, 4.5, 4.1], range(5, 8), 0.6) == ([5.0, 4.5, 4.1], [4.1, 4.5, 4.1], [7, 6, 7])
    assert folds.effect([math.nan, math.inf], [0, 1], 0.0) == ([], [], [])


@pytest.mark.parametrize(("least", "size"), [(0.0, 4), (0.75, 3), (0.75, 1), (2.0, 64)])
def test_progress_against_a_loop(spark, least, size):
    rnd = random.Random(7)
    series = {None: [3.0, 2.0], "a": [rnd.choice([None, math.nan, math.inf, -math.inf]) if rnd.random() < 0.1 else 30 - k / 4 + rnd.randrange(8) / 4 for k in range(97)], "b": [None, math.nan], "c": [1.0], "d": [20 - k / 8 for k in range(50)], "e": [2.0] * 9}
    rows = [(run, k, v) for run, values in series.items() for k, v in enumerate(values)]
    rnd.shuffle(rows)
    out = folds.progress(spark.createDataFrame(rows, "run string, step int, value double"), S, least, size).collect()
    assert {(r.run, r.step): (r.best, r.since, r.place) for r in out} == {(run, k): x for run, values in series.items() for k, x in enumerate(slow(values, least))}
    assert len(out) == len(rows)


def test_stagnations(spark):
    values = [5.0, 4.9, 4.8, 4.7, 3.0, 3.0, 3.0, 3.0, 2.0, 2.0, 2.0]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("b", 0, 1.0)], "run string, step int, value double")
    assert {(r.run, r.fired_at, r.best) for r in folds.stagnations(rows, S, 2, 0.5, 4).collect()} == {("a", 2, 5.0), ("a", 6, 3.0), ("a", 10, 2.0)}
    assert {(r.run, r.stopped_at) for r in folds.stopped(rows, S, 3, 0.5, 4).collect()} == {("a", 3), ("b", None)}
    assert folds.progress(rows.limit(0), S).count() == 0
    with pytest.raises(ValueError, match="negative"):
        folds.progress(rows, S, -1.0)
