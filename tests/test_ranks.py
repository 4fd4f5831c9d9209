"""Places, moving means and splits over whole groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import history, ranks, sampling


def test_places_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 9 else None, k, rng.randrange(50)) for k in range(3000)] + [("a", 5, 1)] * 500
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(7)
    got = ranks.numbered(df, ["g"], [F.col("o")], {"upto": F.col("x")}).collect()
    assert len(got) == len(rows)
    for g in (None, "a", "b"):
        mine = sorted((r.o, r.place, r.upto, r.x) for r in got if r.g == g)
        placed = sorted((place, o, x, upto) for o, place, upto, x in mine)
        assert [p[0] for p in placed] == list(range(1, len(mine) + 1))
        assert [p[1] for p in placed] == sorted(p[1] for p in placed)
        total = 0
        for _, _, x, upto in placed:
            total += x
            assert upto == total
    assert ranks.numbered(df.where("o < 0"), ["g"], [F.col("o")]).collect() == []


@pytest.mark.parametrize(("values", "alpha"), [([1e30] + [1.0] * 499, 0.9), ([float("inf")] + [1.0] * 2000, 0.9), ([float(k % 7) for k in range(5000)], 0.9999), ([3.0], 0.5)])
def test_moving_mean_of_all_rows(spark, values, alpha):
    ema = values[0]
    for x in values[1:]:
        ema = alpha * ema + (1 - alpha) * x
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(values)], "t string, o int, x double").repartition(5)
    got = history.moving_mean(df, "t", ["o"], "x", alpha).first()
    assert got.n == len(values) and got.ema == pytest.approx(ema)


def test_runs_over_ranges(spark):
    rows = [("s", k, "ab"[(k // 400) % 2]) for k in range(2000)] + [("t", k, None) for k in range(5)]
    got = {(r.s, r.v): r.runs for r in history.contiguous(spark.createDataFrame(rows, "s string, o int, v string"), "s", "v", "o").collect()}
    assert got == {("s", "a"): 3, ("s", "b"): 2, ("t", None): 1}


def test_split_keeps_every_row_once(spark):
    rows = [(k // 2, k) for k in range(10)]
    got = sampling.split_off(spark.createDataFrame(rows, "k int, x int"), 0.4, "k").collect()
    assert sorted(r.x for r in got) == list(range(10)) and sum(r.split == "val" for r in got) == 4
    hot = spark.createDataFrame([(1, k) for k in range(1000)], "k int, x int")
    assert sorted(r["count"] for r in sampling.split_off(hot, 0.25, "k").groupBy("split").count().collect()) == [250, 750]
    assert sampling.split_off(hot.where("x < 0"), 0.25, "k").collect() == []


@pytest.mark.parametrize(("total", "world", "batch"), [(103, 6, 4), (24, 6, 4), (5, 6, 1), (1, 3, 2), (1003, 6, 4), (95, 6, 8)])
def test_shards_are_a_loaders(spark, total, world, batch):
    per = -(-total // world)
    seen = {(turn * world + rank) % total for rank in range(world) for turn in range(per // batch * batch)}
    got = sampling.sharded(spark.range(total).repartition(3), "id", world, batch).collect()
    assert sorted(r.id for r in got) == list(range(total))
    assert {r.id for r in got if not r.missed} == seen and all(r["rank"] == r.id % world for r in got)


def test_key_values(spark):
    from granary.functions.text import key_values

    rows = ["a=1,b=2", "a=1,a=3", "x", "a= b = c ,d=", "", None]
    got = [r.m for r in spark.createDataFrame([(k, s) for k, s in enumerate(rows)], "k int, s string").select("k", key_values(F.col("s")).alias("m")).orderBy("k").collect()]
    assert got == [{"a": "1", "b": "2"}, {"a": "3"}, {"x": None}, {"a": "b = c", "d": ""}, {}, None]
