"""Vector codes against Lloyd's rounds with every distance measured."""

from __future__ import annotations

import math

import numpy as np
import pytest

from granary.llm import quantize
from granary.llm.quantize import Moved, compress, decoded, digest, label_errors, reassign, squares

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale=256):
    """{row number: (code, error)} and the books, of rows (id, vector, label) that can be read."""
    fine = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    whole = [[math.floor(v * scale) for v in r[1]] for r in fine]
    width = len(whole[0]) // parts
    order = sorted(range(len(fine)), key=lambda k: (fine[k][0] is None, fine[k][0], whole[k]))
    books = [[whole[k][p * width : (p + 1) * width] for k in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for w in whole:
            dist = [[sum((a - b) ** 2 for a, b in zip(w[p * width : (p + 1) * width], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(min(d), d.index(min(d))) for d in dist])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [w[p * width : (p + 1) * width] for w, f in zip(whole, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    return fine, [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found], books


def hold(spark, rows, parts=4, entries=8, rounds=2, schema=SCHEMA):
    coded, books = compress(spark.createDataFrame(rows, schema).repartition(3), parts=parts, entries=entries, rounds=rounds)
    fine, told, wanted = plain(rows, parts, entries, rounds)
    assert books.tolist() == wanted
    got = sorted((str(r["id"]), r["code"].hex(), r["error"]) for r in coded.collect())
    assert got == sorted((str(f[0]), *t) for f, t in zip(fine, told, strict=True))
    return coded, books


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_against_all_distances(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(int(k), [float(x) for x in rng.normal(size=16) * rng.choice([0.01, 1.0])], int(k % 3)) for k in rng.permutation(500)]
    hold(spark, rows, rounds=rounds)


def test_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    # few different integers: most distances tie
    rows = [(k // 2, [float(x) / 256 for x in rng.integers(-2, 3, 8)], None if k % 4 else 1) for k in range(300)] + [(7, [0.0] * 8, 1)] * 50
    coded, _ = hold(spark, rows)
    errors = {}
    for r in label_errors(coded).collect():
        assert errors.setdefault(r["label"], r["label_error"]) == r["label_error"]
    sums = {}
    for r in coded.collect():
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert errors == sums


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    hold(spark, [(k, [float(x) for x in rng.uniform(-(2**20) + 1, 2**20 - 1, 8)], 0) for k in range(60)], entries=5)


def test_pruning_measures_less_and_loses_nothing():
    rng = np.random.default_rng(5)
    x, old = rng.integers(-500, 500, (4000, 4)), rng.integers(-500, 500, (64, 4))
    new = old + rng.integers(-8, 9, old.shape)
    d = squares(x, old)
    code = d.argmin(1)
    moved = Moved(old[None], new[None])
    got, upper, lower, measured = reassign(x, new, moved.by[0], moved.half[0], moved.nearest[0], code, np.sqrt(d.min(1)) * quantize._UP, np.sqrt(d) * quantize._DOWN)
    exact = squares(x, new)
    assert (got == exact.argmin(1)).all()
    assert (upper**2 >= exact.min(1) - 1e-6).all() and (lower**2 <= exact + 1e-6).all()
    assert measured < 0.2 * exact.size


def test_cases(spark):
    rng = np.random.default_rng(6)
    vec = lambda: [float(x) for x in rng.normal(size=8)]
    odd = [(None, vec(), 1), (None, vec(), None), (13, None, 1), (14, [math.nan] * 8, 1), (15, [1.0] * 7 + [math.inf], 1), (16, [None] + [1.0] * 7, 1)]
    rows = [(k, vec(), 2) for k in range(10)] + odd
    hold(spark, rows, entries=20)
    # other lengths and huge components can't be compared
    more = [*rows, (20, [1.0] * 9, 1), (21, [], 1), (22, [1e30] * 8, 1)]
    coded, books = compress(spark.createDataFrame(more, SCHEMA), parts=4, entries=20)
    assert sorted(str(r["id"]) for r in coded.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (13, 14, 15, 16))
    # a length that the parts don't divide is filled up with zeros
    three, books = compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.5], 0)], SCHEMA), parts=2)
    assert books.tolist() == [[[256, 512], [256, 512]], [[768, 0], [896, 0]]] and {r["error"] for r in three.collect()} == {0}
    none, books = compress(spark.createDataFrame([(1, None, 0)], SCHEMA))
    assert label_errors(none).collect() == [] and books.size == 0 and digest(books)
    long, _ = compress(spark.createDataFrame([(1, [0.5] * 50_000, 0), (2, [0.25] * 50_000, 0)], SCHEMA))
    assert [r["error"] for r in long.collect()] == [0, 0]


def test_further_columns_and_decoding(spark):
    rows = spark.createDataFrame([(k, [k / 4] * 16, "a", k, b"c") for k in range(5)], "vec_id long, embedding array<float>, label string, id int, code binary")
    coded, books = compress(rows)
    assert [(r["id"], r["label"]) for r in coded.orderBy("id").collect()] == [(k, "a") for k in range(5)]
    for r in decoded(coded, books).collect():
        assert r["vec"] == pytest.approx([r["id"] / 4] * 16, abs=1 / 256)
