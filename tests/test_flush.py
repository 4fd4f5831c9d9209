"""Interval means as a stream against the batch answer, for several splits, late rows, counts and a restart."""

from __future__ import annotations

import json
import os
import random

import pytest

from granary.streaming.flush import interval_means, rocks
from granary.streaming.logs import log_stream

SCHEMA = "key string, step long, value double"


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    at = folder / f"{k:03d}.json"
    at.write_text("".join(json.dumps(dict(zip(("key", "step", "value"), r, strict=True))) + "\n" for r in rows))
    os.utime(at, (1e9 + k, 1e9 + k))  # streams take files in order of their times


def run(spark, tmp_path, every, late=1, full=None, files=1):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    with rocks(spark):
        means = interval_means(log_stream(spark, f"{tmp_path}/in", SCHEMA, files), "key", "step", "value", every, late, full)
        means.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = [(r.key, r.flush, r.n, round(r.mean, 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def wanted(rows, every):
    by = {}
    for key, step, value in rows:
        by.setdefault((key, step // every), []).append(value)
    return sorted((k, f, len(v), round(sum(v) / len(v), 9)) for (k, f), v in by.items())


def steps(n, seed=1):
    """Three micro-batches a step."""
    rng = random.Random(seed)
    return [(rng.choice("abc"), s // 3, rng.random()) for s in range(3 * n)]


@pytest.mark.parametrize("files", [1, 5])
def test_any_split_gives_the_batch_answer(spark, tmp_path, files):
    rows, rng, at, k = steps(200), random.Random(files), 0, 0
    while at < len(rows):
        stop = at + rng.randrange(1, 270)
        put(tmp_path / "in", k, rows[at:stop])
        at, k = stop, k + 1
    put(tmp_path / "in", k, [(None, 220, None)])
    assert run(spark, tmp_path, 20, files=files) == wanted(rows, 20)


def test_restart_and_epoch_end(spark, tmp_path):
    rows = steps(100, 2)
    put(tmp_path / "in", 0, rows[:165])
    first = run(spark, tmp_path, 20)
    assert first == [w for w in wanted(rows, 20) if w[1] < 2]
    put(tmp_path / "in", 1, rows[165:])
    put(tmp_path / "in", 2, [(None, 200, None)])
    assert run(spark, tmp_path, 20) == wanted(rows, 20)


def test_late_rows_and_full_intervals(spark, tmp_path):
    rows = [("a", s, float(s)) for s in range(40)]
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(10))
    for k in range(4):
        put(tmp_path / "in", k, shuffled[10 * k : 10 * k + 10])
    # ten values make an interval: all are flushed by count, without an end of the epoch
    assert run(spark, tmp_path, 10, late=20, full=10) == wanted(rows, 10)


def test_a_timer_reads_its_own_interval_alone():
    from types import SimpleNamespace

    from granary.streaming.flush import IntervalMeans

    reads, held = [], {}
    state = SimpleNamespace(containsKey=lambda k: k in held, getValue=lambda k: reads.append(k) or held[k], updateValue=held.__setitem__, removeKey=held.pop)
    timers = []
    means = IntervalMeans(10, None)
    means.init(SimpleNamespace(getMapState=lambda *a: state, registerTimer=timers.append))
    assert not list(means.handleInputRows(("a",), iter([SimpleNamespace(step=k, value=float(k)) for k in range(100)]), None))
    assert timers == [10_000 * k for k in range(1, 11)]
    for at in timers:
        (r,) = means.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
        assert (r.n, r.mean) == (10, at / 1000 - 5.5)
    assert len(reads) == 10 and not held
