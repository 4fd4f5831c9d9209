"""Group splits, ranks behind a barrier, resumable stages, linked splits."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.operators.splits import split_groups
from granary.sources.arrow import read_shards
from granary.sources.barrier import write_ranks
from granary.sources.linked import link_subset, read_split, remove_subset, splits_of
from granary.sources.stages import Stages, listing


def loop(rows, train, val):
    """Group by group, the largest first."""
    groups: dict = {}
    for key, order in rows:
        groups.setdefault(key, []).append(order)
    ranked = sorted(groups, key=lambda k: (len(groups[k]), min(groups[k])), reverse=True)
    out, n = {}, len(rows)
    counts = {"train": 0, "val": 0}
    for k in ranked:
        size = len(groups[k])
        if counts["train"] + size > train * n + 1e-9:
            if counts["train"] + counts["val"] + size > (train + val) * n + 1e-9:
                out[k] = "test"
                continue
            out[k] = "val"
        else:
            out[k] = "train"
        counts[out[k]] += size
    return out


@pytest.mark.parametrize(("seed", "train", "val"), [(1, 0.8, 0.1), (2, 0.5, 0.25), (3, 0.98, 0.0), (4, 0.0, 1.0)])
def test_group_split_is_the_loop(spark, seed, train, val):
    rng = random.Random(seed)
    rows = [(f"k{int(rng.expovariate(0.1))}" if rng.random() > 0.05 else None, k) for k in range(900)]
    rows += [("hot", 1000 + k) for k in range(300 * (seed == 2))]
    got = split_groups(spark.createDataFrame(rows, "key string, o int").repartition(5), "key", "o", train, val).collect()
    assert sorted(r.o for r in got) == sorted(o for _, o in rows)
    wanted = loop(rows, train, val)
    assert {(r.key, r.split) for r in got} == set(wanted.items())


def test_group_split_cases(spark):
    assert split_groups(spark.createDataFrame([], "key string, o int"), "key", "o").collect() == []
    one = split_groups(spark.createDataFrame([("a", k) for k in range(10)], "key string, o int"), "key", "o").collect()
    assert {r.split for r in one} == {"test"}


def test_all_ranks_or_none(spark, tmp_path):
    at, flag = f"{tmp_path}/ranks", tmp_path / "failed"
    flag.mkdir()

    def once(rank):
        if rank == 2 and not (flag / "seen").exists():
            (flag / "seen").write_text("1")
            raise RuntimeError("this rank is lost")

    rows = spark.range(1000)
    told = write_ranks(rows, at, 4, "id", once)
    assert (flag / "seen").exists()
    assert len(told) == 4 and sum(told) == 1000
    assert sorted(r.id for r in read_shards(spark, at).collect()) == list(range(1000))
    # the first attempt's shards are in no list
    assert len(json.loads((tmp_path / "ranks/state.json").read_text())["shards"]) == 4 < len(list((tmp_path / "ranks").glob("*.arrow")))

    def always(rank):
        if rank == 1:
            raise RuntimeError("this rank is always lost")

    with pytest.raises(Exception):  # noqa: B017
        write_ranks(spark.range(5), at, 4, "id", always)
    assert read_shards(spark, at).count() == 1000
    assert write_ranks(rows.where("id < 0"), f"{tmp_path}/none", 2) == [0, 0] and read_shards(spark, f"{tmp_path}/none", schema="id long").collect() == []


def _long(spark, docs, least):
    return docs.where(F.col("n") >= least)


def _counted(spark, kept):
    return kept.groupBy("k").agg(F.count("*").alias("n"))


def _broken(spark, kept):
    return kept.select(F.raise_error(F.lit("broken")).alias("x"))


def build(spark, root, source, least=5, fail=False):
    stages = Stages(spark, root)
    stages.run("kept", _long, {"docs": source}, least=least)
    if fail:
        stages.run("counted", _broken, after=["kept"])
    return stages, stages.run("counted", _counted, after=["kept"])


def test_stages_resume(spark, tmp_path):
    source, root = f"{tmp_path}/docs", f"{tmp_path}/build"
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    rows.write.parquet(source)
    with pytest.raises(Exception, match="broken"):
        build(spark, root, source, fail=True)
    stages, out = build(spark, root, source)
    assert (stages.ran, stages.skipped) == (["counted"], ["kept"]) and sum(r.n for r in out.collect()) == 95
    stages, _ = build(spark, root, source)
    assert (stages.ran, stages.skipped) == ([], ["kept", "counted"])
    stages, out = build(spark, root, source, least=50)
    assert stages.ran == ["kept", "counted"] and sum(r.n for r in out.collect()) == 50
    rows.limit(10).write.mode("append").parquet(source)
    stages, _ = build(spark, root, source, least=50)
    assert stages.ran == ["kept", "counted"]
    # one table of each stage is left
    assert len(list((tmp_path / "build/kept").glob("*/_SUCCESS"))) == 1
    with pytest.raises(ValueError, match="no table"):
        stages.table("other")


def test_linked_splits(spark, tmp_path):
    root, subset = f"{tmp_path}/all", f"{tmp_path}/sub"
    for name, n in (("train", 100), ("val", 20), ("test", 30)):
        spark.range(n).repartition(2).write.parquet(f"{root}/{name}")
    before = listing(spark, root)
    told = link_subset(root, subset, "test", read_split(spark, root, "test").where("id < 7"))
    assert {k: read_split(spark, subset, k).count() for k in told} == {"train": 100, "val": 20, "test": 7}
    assert all("/sub/" in f for f in told["test"]) and all("/all/" in f for k in ("train", "val") for f in told[k])
    assert not (tmp_path / "sub/train").exists()
    # a subset of a subset refers to the first source
    more = link_subset(subset, f"{tmp_path}/more", "val", read_split(spark, subset, "val").limit(3))
    assert more["train"] == told["train"] and splits_of(spark, f"{tmp_path}/more") == more
    remove_subset(spark, subset)
    assert listing(spark, root) == before and read_split(spark, root, "test").count() == 30
    with pytest.raises(Exception):  # noqa: B017
        read_split(spark, f"{tmp_path}/more", "test").collect()
    with pytest.raises(ValueError, match="no split"):
        link_subset(root, subset, "dev", spark.range(1))
