"""Text scores against plain counting, METEOR against all alignments."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import texts


def plain(ref, hyp, n):
    a, b = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (hyp, ref))
    return [sum(min(c, b[g]) for g, c in a.items()), max(len(hyp) - n + 1, 0), max(len(ref) - n + 1, 0)]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_counts_and_subsequences(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, rng.choices("abcdefg", k=rng.randrange(0, 30)), rng.choices("abcdefg", k=rng.randrange(0, 30))) for k in range(200)] + [(900, None, ["a"]), (901, [], []), (902, ["x"] * 500, ["x"] * 300)]
    df = spark.createDataFrame(rows, "k int, ref array<string>, hyp array<string>").repartition(3)
    got = {r.k: r.c for r in df.select("k", texts.compared(F.col("ref"), F.col("hyp"), 4, True).alias("c")).collect()}
    for k, ref, hyp in rows:
        ref, hyp = ref or [], hyp or []
        assert got[k] == [x for n in (1, 2, 3, 4) for x in plain(ref, hyp, n)] + [longest(ref, hyp)]


def test_scores_of_groups(spark):
    rng = random.Random(2)
    rows = [(f"g{k % 2}", rng.choices("abc", k=12), rng.choices("abc", k=9)) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, ref array<string>, hyp array<string>")
    for r in texts.text_scores(df, ["g"]).collect():
        mine = [(a, b) for g, a, b in rows if g == r.g]
        sums = [[sum(plain(a, b, n)[i] for a, b in mine) for i in range(3)] for n in (1, 2, 3, 4)]
        brevity = min(0.0, 1 - 12 / 9)
        assert r.n == len(mine)
        for most in (2, 4):
            assert r[f"bleu{most}"] == pytest.approx(100 * math.exp(brevity + sum(math.log(m / t) / most for m, t, _ in sums[:most])))
        assert r.rouge2 == pytest.approx(100 * sum(2 * plain(a, b, 2)[0] / (plain(a, b, 2)[1] + plain(a, b, 2)[2]) for a, b in mine) / len(mine))
        assert r.rouge_l == pytest.approx(100 * sum(2 * longest(a, b) / 21 for a, b in mine) / len(mine))
    assert texts.text_scores(df.where("g = 'none'"), ["g"]).collect() == []


def best(ref, hyp, fixed):
    """The most matches, then the fewest chunks, over all alignments of the free places."""
    free = [i for i in range(len(hyp)) if i not in fixed]
    options = [[None, *[j for j in range(len(ref)) if j not in fixed.values() and ref[j] == hyp[i] and ref[j] is not None]] for i in free]
    found = []
    for chosen in itertools.product(*options):
        used = [j for j in chosen if j is not None]
        if len(used) == len(set(used)):
            m = fixed | {i: j for i, j in zip(free, chosen, strict=True) if j is not None}
            found.append((-len(m), texts.chunks(m)))
    return min(found)


@pytest.mark.parametrize("letters", ["abcd", "ab", "abcdefgh"])
def test_alignments_are_the_best(letters):
    rng = random.Random(len(letters))
    for _ in range(150):
        a, b = rng.choices(letters, k=rng.randrange(0, 7)), rng.choices(letters, k=rng.randrange(0, 7))
        first = texts.align(a, b, {}, 10**6)
        assert all(a[j] == b[i] for i, j in first.items()) and (-len(first), texts.chunks(first)) == best(a, b, {})
        # a second stage over classes of letters, with what the first has found
        c, d = ([x if x in "ab" else "c" for x in s] for s in (a, b))
        second = texts.align(c, d, first, 10**6)
        assert first.items() <= second.items() and (-len(second), texts.chunks(second)) == best(c, d, first)
        plainer = texts.follow(a, b, {})
        assert len(plainer) == len(first) == len(set(plainer.values())) and all(a[j] == b[i] for i, j in plainer.items())


def test_meteor(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the cat sat on the mat", "on the mat sat the cat"), (3, "cats running", "cat runs"), (4, "big house", "large home"), (5, "a", "b"), (6, "", "b"), (7, None, "x")]
    df = spark.createDataFrame(rows, "k int, r string, h string").select("k", F.filter(F.split("r", " "), lambda w: w != "").alias("ref"), F.split("h", " ").alias("hyp"))
    known = spark.createDataFrame([("big", "1"), ("large", "1"), ("house", "2"), ("home", "2")], "word string, class string")
    got = {r.k: r.m for r in df.select("k", texts.meteor(F.col("ref"), F.col("hyp"), known).alias("m")).collect()}
    assert got[1] == pytest.approx(1 - 0.5 / 6**3) and got[2] == pytest.approx(1 - 0.5 * (3 / 6) ** 3)
    assert got[3] == got[4] == pytest.approx(1 - 0.5 / 8)
    assert (got[5], got[6], got[7]) == (0.0, 0.0, 0.0)
    words = [f"w{k % 50}" for k in range(3000)]
    long = spark.createDataFrame([(words, words[3:])], "ref array<string>, hyp array<string>").select(texts.meteor(F.col("ref"), F.col("hyp")).alias("m")).first()
    assert 0.9 < long.m <= 1


def test_stems(spark):
    words = {"cats": "cat", "classes": "class", "ponies": "poni", "glass": "glass", "hopping": "hop", "falling": "fall", "hoped": "hop", "sing": "sing", "red": "red", "": ""}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", texts.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words
