"""Mixing: targets by plain resharing, exact budgets, cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from granary.llm.mixing import mix, mixture, n_words, targets

from .helpers import empty, odd


def reshared(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """The contract's words, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, left = total - sum(most * sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * w[s] / left for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > most * sizes[s]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20}, {"a": 1, "b": 1, "c": 1000, "d": 3, None: 40}, {f"s{k}": (k * 37) % 101 for k in range(40)}, {"x": 0, "y": 7}, {"Z": 5, "a": 5, "é": 5, "😀": 100, "￮": 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(rows).collect()}
    assert got == pytest.approx(reshared(sizes))


def check(rows, found, most=3):
    by = {}
    for r in found:
        size, goal, taken = by.setdefault(r["source"], [0, r["target"], 0])
        by[r["source"]] = [size + r["size"], goal, taken + r["taken"]]
        assert 0 <= r["taken"] <= most * r["size"]
    goals = reshared({s: v[0] for s, v in by.items()}) if by else {}
    for s, (size, goal, taken) in by.items():
        assert goal == pytest.approx(goals[s])
        assert {r["source_size"] for r in found if r["source"] == s} == {size}
    return by


def test_budgets_are_exact_and_reruns_agree(spark):
    texts = [(k, " ".join(["w"] * (k * k % 50)), f"s{k % 7}" if k % 7 else None) for k in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    found = mix(docs).collect()
    assert len(found) == 3000
    for size, goal, taken in check(texts, found).values():
        assert taken == int(goal) and taken <= 3 * size
    again = mix(docs.repartition(13)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    # what one epoch more takes of a source is a front of its random order
    for s in {r["source"] for r in found}:
        parts = {r["taken"] % r["size"] for r in found if r["source"] == s and r["size"]}
        assert len(parts - {0}) <= 1


def test_equal_rows_share_alike(spark):
    rows = [(None, "a b c", "x")] * 1000 + [(k, "d e", "y") for k in range(50)] + [(7, "d e", "y")] * 3
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == len(rows)
    assert len({r["taken"] for r in found if r["source"] == "x"}) == 1
    for _, goal, taken in check(rows, found).values():
        assert goal - 1000 < taken <= goal


def test_the_mix_itself(spark):
    rows = [(1, " a b  c ", "x"), (2, "d e f g", "x"), (3, " ".join("h" * 30), "y"), (4, None, "y"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix(docs)
    words = {}
    for r in mixture(docs, mixed).collect():
        words[r["id"]] = words.get(r["id"], 0) + len(r["text"].split())
    assert words == {r["id"]: r["taken"] for r in mixed.collect() if r["taken"]}


def test_words(spark):
    texts = [None, "", "  ", "a", " a\tb\x0bc\r\n", "ü x \x1f y", " ".join(["q"] * 200_000), "\x0c" * 50 + "z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_cases(spark):
    assert mix(empty(spark), source_col="id").collect() == []
    rows = odd(spark)
    found = mix(rows, source_col="id").collect()
    assert len(found) == rows.count()
    check(None, found)
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mix(blank).collect()] == [(0, 0.0, 0)] * 2
