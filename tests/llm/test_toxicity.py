"""op3: held-out accuracy on made-up documents, forward-backward against enumeration, edge cases."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from granary.llm import queries, toxicity

from .helpers import SF, empty, odd


def enumerated(model, weights, places, n):
    """P(T) at places by summing over all tag sequences."""
    emit = [model.bias] * n
    for p, w in zip(places, weights, strict=True):
        emit[p] = w
    total, at = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        before, s = 0, 0.0
        for t, e in zip(tags, emit, strict=True):
            s += model.moves[before][t] + e * t
            before = t
        total += math.exp(s)
        at += math.exp(s) * np.array(tags)
    return (at / total)[places]


@pytest.mark.parametrize("seed", range(5))
def test_marginals(seed):
    rng = np.random.default_rng(seed)
    model = toxicity.Field(bias=-1.0, moves=rng.normal(size=(2, 2)))
    places = sorted(rng.choice(9, 3, replace=False).tolist())
    weights = rng.normal(size=3).tolist()
    assert toxicity.marginals(model, places, weights, 9) == pytest.approx(enumerated(model, weights, places, 9))


def made(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"plain{i}" for i in range(400)], ["vile", "stinking", "rotten"]
    out = []
    for _ in range(n):
        y = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 4) if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "est", "ly"]))
        out.append((" ".join(words), int(y)))
    return out


def test_held_out_accuracy_and_spans():
    model = toxicity.fit(made(600, 1))
    test = made(300, 2)
    right = sum((toxicity.score_text(model, t)[0] >= 0.7) == y for t, y in test)
    assert right >= 0.97 * len(test)
    text = "plain1 rotten plain2"
    (span,) = toxicity.score_text(model, text)[1]
    assert text[span[0] : span[1]] == "rotten"


def test_one_kind_of_label_and_nothing():
    assert toxicity.score_text(toxicity.fit([("a b", 0)] * 3), "a b")[0] < 1e-9
    assert toxicity.score_text(toxicity.fit([]), None)[0] < 1e-9
    assert 0 <= toxicity.score_text(toxicity.fit([("same", 0), ("same", 1)] * 5), "")[0] < 0.7


def test_edges(spark):
    model = toxicity.fit(made(200, 1))
    assert toxicity.tag(odd(spark), model).count() == odd(spark).count()
    scored = toxicity.scored(odd(spark), model)
    assert scored.columns == [*odd(spark).columns, "score"] and scored.where("score >= 0.7 or score is null").count() == 0
    assert toxicity.tag(empty(spark), model).count() == 0
    labels = spark.createDataFrame([(5, 1), (2, 0), (None, 1), (99, 1), (4, None)], "doc_id long, toxic int")
    toxicity.learn(odd(spark), labels)


def test_query(spark):
    got = queries.op3_toxicity(spark, SF).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_rows_of_a_table(spark):
    """Toxic rows kept from learning: at least 14 of the 18 are found (of the others, one has no sign of its label, three are of languages with four to six toxic rows), and no clean row."""
    at = "/root/testdata/sf0.01"
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(told[r.doc_id], r.predicted) for r in queries.op3_toxicity(spark, at).collect() if r.held_out and r.doc_id in told]
    assert sum(y for y, _ in got) == 18 and sum(p for y, p in got if y) >= 14 and sum(p for y, p in got if not y) == 0
