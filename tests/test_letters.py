"""A poisoned batch is set aside, the stream goes on, nothing is counted twice."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from granary.streaming.letters import Recorder, again, guarded, letters
from granary.streaming.logs import log_stream

SCHEMA = "k string, v int"


def counted(batch):
    checked = batch.withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("poison")).cast("int")).otherwise(F.col("v")))
    return checked.groupBy("k").agg(F.sum("v").alias("v"))


def test_dead_letters(spark, tmp_path):
    src, out, log = (f"{tmp_path}/{n}" for n in ("in", "out", "log"))
    recorder = Recorder()
    spark.streams.addListener(recorder)
    try:
        for k in range(4):
            spark.createDataFrame([("a", k), ("b", -1 if k == 2 else 10)], SCHEMA).coalesce(1).write.mode("append").json(src)
            guarded(log_stream(spark, src, SCHEMA), counted, out, log, "guarded").awaitTermination()
        until = time.time() + 20
        while len([b for b in recorder.batches if b[2]]) < 4 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(recorder)
    done = letters(spark, out, "done", "k string, v long")
    assert {(r.k, r.v) for r in done.groupBy("k").agg(F.sum("v").alias("v")).collect()} == {("a", 0 + 1 + 3), ("b", 30)}
    dead = letters(spark, out, "dead", f"{SCHEMA}, _error string").collect()
    assert sorted((r.k, r.v) for r in dead) == [("a", 2), ("b", -1)] and len({r.batch for r in dead}) == 1 and all("poison" in r._error for r in dead)
    assert [b[2] for b in recorder.table(spark).where("rows > 0").orderBy("batch").select("query", "batch", "rows").collect()] == [2] * 4
    # a repaired aggregate takes the letter up, once
    assert again(spark, out, SCHEMA, counted) == []
    fixed = lambda rows: counted(rows.where("v >= 0"))
    assert len(again(spark, out, SCHEMA, fixed)) == 1 and again(spark, out, SCHEMA, fixed) == []
    assert {(r.k, r.v) for r in letters(spark, out, "done", "k string, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()} == {("a", 6), ("b", 30)}
    assert letters(spark, f"{out}/none", "dead", SCHEMA).collect() == []
