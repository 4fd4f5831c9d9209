"""Means of intervals of steps as a stream: values are buffered per key and flushed once, by count, by steps passed or at an epoch's end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEANS = "key string, flush long, n long, mean double"
_VALUES = "steps array<long>, vals array<double>"


class IntervalMeans(StatefulProcessor):
    """The values of each interval that isn't flushed yet, under its number, and a timer for each.

    An interval is flushed when ``full`` values of it are there, else when the watermark passes its last step: late values within
    the watermark's delay still count, whatever micro-batch brings them. Rows and timers touch their own intervals alone.
    """

    def __init__(self, every: int, full: int | None):
        self.every, self.full = every, full

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "flush long", _VALUES)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        fresh: dict[int, list] = {}
        for r in rows:
            if r.value is not None:
                fresh.setdefault(r.step // self.every, []).append((r.step, r.value))
        for flush in sorted(fresh):
            held = self._held(flush)
            values = held + fresh[flush]
            if self.full is not None and len(values) >= self.full:
                yield _mean(key[0], flush, values)
                if held:
                    self.buffer.removeKey((flush,))
                    self.handle.deleteTimer((flush + 1) * self.every * 1000)
                continue
            if not held:
                self.handle.registerTimer((flush + 1) * self.every * 1000)
            self.buffer.updateValue((flush,), ([v[0] for v in values], [v[1] for v in values]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        flush = expiredTimerInfo.getExpiryTimeInMs() // (self.every * 1000) - 1
        if values := self._held(flush):
            yield _mean(key[0], flush, values)
            self.buffer.removeKey((flush,))

    def _held(self, flush: int) -> list:
        if not self.buffer.containsKey((flush,)):
            return []
        return list(zip(*self.buffer.getValue((flush,)), strict=True))

    def close(self) -> None:
        pass


def _mean(key, flush: int, values: list) -> Row:
    total = 0.0
    for _, value in sorted(values):
        total += value
    return Row(key=key, flush=flush, n=len(values), mean=total / len(values))


@contextmanager
def rocks(spark: SparkSession):
    """The state store that list states and timers need; the session's own comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def interval_means(stream: DataFrame, key: str, step: str, x: str, every: int, late: int = 1, full: int | None = None) -> DataFrame:
    """(key, flush, n, mean) of every ``every`` steps of each key, each interval once.

    Steps from 0 on are the event time, a second each; rows less than ``late`` steps behind the newest still count, so with 1 the rows of a
    step may come in several micro-batches. A row of any key whose value is null is a
    mark: one at the step where an epoch ends, ``late`` steps or more beyond the last interval, flushes what is left of all keys. Run it under ``rocks``.
    """
    named = stream.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(x).cast("double").alias("value"))
    timed = named.withColumn("at", F.timestamp_seconds(F.col("step") + 1)).withWatermark("at", f"{late} seconds")
    return timed.groupBy("key").transformWithState(IntervalMeans(every, full), MEANS, "append", "EventTime")
