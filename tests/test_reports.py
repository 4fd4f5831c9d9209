"""Reports, routing and checks: cases that the tables don't show."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import checks
from granary.operators import decontam, evaluation, history, metrics, reports, training
from granary.sources import tables



@pytest.mark.parametrize("alpha", [0.5, 0.99])
def test_running_mean_is_the_fold(spark, alpha):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 50 else None, k, rng.random()) for k in range(2000)] + [("c", 0, 1e30)] + [("c", k, 1.0) for k in range(1, 300)]
    got = {(r.t, r.o): r.ema for r in history.running_mean(spark.createDataFrame(rows, "t string, o int, x double").repartition(5), "t", ["o"], "x", alpha).collect()}
    seen: dict = {}
    for t, o, x in sorted(rows, key=lambda r: r[1]):
        seen[t] = alpha * seen[t] + (1 - alpha) * x if t in seen else x
        assert got[t, o] == pytest.approx(seen[t])
    assert len(got) == len(rows)


def test_anchored_preferences(spark):
    rows = [("a", 0, 0, 3.0, 1.0, 1.0, 1.0), ("a", 0, 1, 5.0, 1.0, 9.0, 1.0), ("a", 1, 2, 1.0, 1.0, 0.0, 1.0), ("b", 1, 3, 2.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "t string, b int, o int, tw double, rw double, tl double, rl double")
    got = {r.o: r for r in training.anchored_preferences(df, "t", "b", "o", ("tw", "rw", "tl", "rl"), beta=1.0, alpha=0.5, clip=1.0, hinge=True).collect()}
    assert [got[k].average for k in range(4)] == [3.0, 3.0, 1.5, 2.0]  # after the whole batch
    assert [got[k].margin for k in range(4)] == [2.0, -4.0, 0.0, 1.0] and [got[k].loss for k in range(4)] == [0.5, 6.5, 1.75, 1.0]
    assert got[0].right and not got[1].right


def test_as_of_over_ranges(spark):
    rng = random.Random(2)
    right = {(rng.choice("xy"), t): (rng.random() if t % 7 else None) for t in range(0, 3000, 5)}
    left = [(rng.choice("xyz"), rng.randrange(-5, 3000), k) for k in range(1500)] + [("z", 1, 9999)]
    got = evaluation.as_of(spark.createDataFrame(left, "g string, t int, k int").repartition(4), spark.createDataFrame([(g, t, v) for (g, t), v in right.items()], "g string, t int, v double"), "g", "t", "v").collect()
    assert len(got) == len(left)
    for r in got:
        before = [(t, v) for (g, t), v in right.items() if g == r.g and t <= r.t and v is not None]
        assert r.as_of == (max(before)[1] if before else None)


def test_pairs_that_are_all_left_out_fail(spark):
    counts = spark.createDataFrame([("a", "kept", 3), ("a", "no pair", 1), ("b", "no pair", 2)], "b string, outcome string, n long")
    with pytest.raises(ValueError, match="of batch b"):
        evaluation.check_pairs(counts, "b")
    assert evaluation.check_pairs(counts).first() == (3, 3)
    with pytest.raises(ValueError, match="left out"):
        evaluation.check_pairs(counts.where("outcome <> 'kept'"))
    assert evaluation.check_pairs(counts.where("n < 0"), "b").collect() == []


def test_lookup_takes_the_first_number(spark):
    summary = spark.createDataFrame([("val/d/low_confidence_random/m", "x"), ("val/m/d/low_confidence_random", "2"), ("val/d/random_random/m", "3"), ("val/d/likelihood/m", "nan"), ("val/d/random_likelihood/m", "9")], "key string, value string")
    wanted = spark.createDataFrame([("d", "m", "random"), ("d", "m", "likelihood"), ("e", "m", "random")], "dataset string, metric string, strategy string")
    got = {(r.dataset, r.strategy): (str(r.value), r.key) for r in reports.lookup(wanted, summary).collect()}
    assert got == {("d", "random"): ("2.0", "val/m/d/low_confidence_random"), ("d", "likelihood"): ("nan", "val/d/likelihood/m"), ("e", "random"): ("None", None)}


def test_routes(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown tasks: no such"):
        tables.load_tasks(spark, str(tmp_path), ["no such"])


def test_forms(spark):
    smiles = {"CCO": True, "C1CC1": True, "C1CC": False, "CC(C": False, "C)C(": False, "[Na+].[Cl-]": True, "C[C@@H](N)O>>CC": True, "": True, None: True, "<None>": True, "C C": False, "[13CH4]": True, "C]": False, "A>>": False}
    selfies = {"[C][=O]": True, "[C]C": False, "": False, None: False, "[C].[O]>>[N]": True, "[C]>>": False}
    df = spark.createDataFrame([(k,) for k in {*smiles, *selfies}], "s string").select("s", checks.smiles_form(F.col("s")).alias("a"), checks.selfies_form(F.col("s")).alias("b"))
    got = {r.s: (r.a, r.b) for r in df.collect()}
    assert {k: got[k][0] for k in smiles} == smiles and {k: got[k][1] for k in selfies} == selfies


def test_slices_and_lengths(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, None, 5.0), (2, None, None)], "b int, t string, x double")
    assert sorted((r.b, r.t or "", r.n, r.x) for r in reports.slice_means(df, "b", "t", ["x"]).collect()) == [(1, "", 3, 3.0), (1, "a", 1, 1.0), (1, "b", 1, 3.0), (2, "", 1, None)]
    kept, told = reports.within(df, F.col("x"), 3)
    assert kept.count() == 2 and told.first() == (4, 2, 50.0)
    assert reports.toy_splits(df, "b", "t", None) is df and reports.toy_splits(df, "b", "t", 1).count() == 2


def test_summary_is_numpys(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5, None])) for _ in range(3000)] + [("one", 7.0), ("none", None)] + [("same", 2.0)] * 500
    got = {r.g: r for r in metrics.summary(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x").collect()}
    assert set(got) == {"a", "b", "one", "same"}
    for g, r in got.items():
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert r.n == len(x) and [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([x.mean(), x.std(), x.min(), x.max()])
        assert [r.p25, r["median"], r.p75, r.p90] == pytest.approx(np.percentile(x, [25, 50, 75, 90]).tolist())


def test_containment(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x b c d e f g h i y"), (3, "p q"), (4, None), (5, "q p q p q"), (1, "a b c d e f g h i")], "id int, text string")
    items = spark.createDataFrame([(10, "b c d e f g h i z"), (11, "p q"), (12, "nothing like it"), (13, None)], "item_id int, text string")
    assert {r.item_id: r.n_docs for r in decontam.containment(docs, items).collect()} == {10: 2, 11: 2}
