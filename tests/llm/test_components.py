"""Connected components against union-find, by windows and by joins, and what a pass costs."""

from __future__ import annotations

import random

from granary.llm import components

from .helpers import Sets


def held(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    rows = [(r.node, r.component) for r in components.components(df).collect()]
    sets = Sets({x for e in edges for x in e if None not in e and e[0] != e[1]})
    for u, v in edges:
        if u is not None and v is not None and u != v:
            sets.join(u, v)
    assert sorted(rows) == sorted((x, sets.find(x)) for x in sets.up)


def test_passes_by_windows_and_by_joins(spark, monkeypatch):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(-20, 20)]
    star = [(-100, 200 + k) for k in range(30)]
    loose = [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    edges = [*chain, *star, *loose, *star[:5], (1000, 1000), (None, 3), (1001, 1000)]
    rng.shuffle(edges)
    held(spark, edges)
    monkeypatch.setattr(components, "HUB", 10)  # hubs are joined
    held(spark, edges)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_pass_is_one_write(spark, monkeypatch):
    """A pass stores its links only (before: also the minima, between two jobs)."""
    names = []
    monkeypatch.setattr(components, "stored", lambda df, name, keep=components.stored: names.append(name) or keep(df, name))
    held(spark, [(k, k + 1) for k in range(30)])
    assert set(names) == {"links"} and len(names) < 12
