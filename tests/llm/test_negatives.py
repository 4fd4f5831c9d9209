"""Hard negatives against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import negatives
from granary.llm.negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int"
TOLD = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=10, positives=5, negs=5, window=(80, 100)):
    """Every pair of rows compared in Python integers; equal rows are one."""
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    whole = sorted({(r[0], r[2], tuple(math.floor(v * 256) for v in r[1])) for r in fine})
    out = []
    for a in whole:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2], strict=True))  # noqa: B023, E731
        told = sorted((-score(b), b[0], b[1]) for b in whole if b != a)
        for p in [t for t in told if t[2] == a[1]][:positives]:
            near = [t for t in told if t[2] != a[1] and window[0] * -p[0] <= 100 * -t[0] <= window[1] * -p[0]]
            out += [(a[0], p[1], k + 1, t[1], -p[0], -t[0]) for k, t in enumerate(near[:negs])]
    return sorted(out)


def hold(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted(tuple(r[c] for c in TOLD) for r in mine(df, F.col("vec_id") % 10 == 0, **settings).collect())
    assert found == plain(rows)
    return found


@pytest.mark.parametrize(("kind", "pivots"), [("clusters", 12), ("spread", None), ("lengths", 7)])
def test_against_all_pairs(spark, kind, pivots, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "PART", 100)
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(6, 8))
    vec = {"clusters": lambda: centres[rng.integers(6)] + 0.1 * rng.normal(size=8), "spread": lambda: rng.normal(size=8), "lengths": lambda: rng.normal(size=8) * rng.exponential() * 5}[kind]
    rows = [(int(k), [float(x) for x in vec()], int(rng.integers(4))) for k in rng.permutation(400)]
    assert hold(spark, rows, pivots=pivots)


def test_ties_copies_and_one_large_group(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) / 256 for x in rng.integers(-1, 2, 4)], int(k % 3)) for k in range(150)]
    rows += [(1000 + k, [1.0, 1.0, 0.5, 0.0], 1) for k in range(200)] + [(7, [0.0] * 4, 1)] * 40
    assert hold(spark, rows)


def test_pruning_sends_a_part_only(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 8))
    x = 3 * x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(v) for v in x[k % 20] + 0.02 * rng.normal(size=8)], k % 3) for k in range(2000)]
    asked = [r for r in rows if r[0] % 100 == 0]
    space = negatives.Space(np.array([[math.floor(v * 256) for v in r[1]] for r in rows[:40]]), np.array([sum(math.floor(v * 256) ** 2 for v in r[1]) for r in rows[:40]]), 1 << 20, 40)
    a = np.array([[math.floor(v * 256) for v in r[1]] for r in asked])
    all_ = np.array([[math.floor(v * 256) for v in r[1]] for r in rows])
    s = a @ all_.T
    low = np.sort(s, axis=1)[:, -6]
    d, (near, far) = space.anchor_distances(a), space.span(a, low, np.full(len(a), negatives.NONE))
    cells = space.row_distances(all_)
    home, r = cells.argmin(1), cells.min(1)
    least, most = d - far[:, None] - space.slack, d + far[:, None] + space.slack
    served = (r[None] >= least[:, home]) & (r[None] <= most[:, home])
    assert served[s >= low[:, None]].all()
    assert served.mean() < 0.3


def test_cases(spark):
    rng = np.random.default_rng(6)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    odd = [(None, vec(), 1), (200, vec(), None), (210, None, 1), (220, [math.nan] * 4, 1), (230, [1.0] * 3 + [math.inf], 1), (240, [None] + [1.0] * 3, 1)]
    rows = [(k, vec(), k % 2) for k in range(40)] + odd + [(0, vec(), 0), (0, vec(), 1)] * 2 + [(-10, vec(), 1), (-7, vec(), 0)]
    assert hold(spark, rows)
    more = spark.createDataFrame([*rows, (20, [1.0] * 9, 1), (30, [], 1), (40, [1e30] * 4, 1)], SCHEMA)
    assert sorted(tuple(r[c] for c in TOLD) for r in mine(more, F.col("vec_id") % 10 == 0).collect()) == plain(rows)
    assert hold(spark, [(0, [1.0], 1)]) == [] and hold(spark, [(0, [1.0], 1), (1, [2.0], 1)]) == []
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    # zero and negative scores: a window of zero holds zeros only, a negative one nothing
    hold(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [-1.0, 0.0], 1), (4, [-0.9, 0.0], 2)])


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    hold(spark, [(k, [float(x) for x in rng.uniform(0, 2**19, 3)], k % 2) for k in range(60)])


def test_further_columns_and_labels(spark):
    rows = spark.createDataFrame([(k, [1.0, k / 100], "ab"[k % 2], k, "x", [1]) for k in range(30)], "vec_id long, embedding array<float>, label string, id int, ask string, low array<int>")
    found = sorted(tuple(r[c] for c in TOLD) for r in mine(rows, F.col("id") % 10 == 0).collect())
    assert found == plain([(k, [1.0, float(np.float32(k / 100))], k % 2) for k in range(30)])
