"""Prediction logs as streams: merge with first-wins dedup, running task statistics, and exactly-once sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Append-only JSON-lines files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str, index: str) -> DataFrame:
    """First row of each key within the watermark; rows with a negative index all pass. State ends with the watermark."""
    marked = stream.withWatermark(time, late)
    alone = F.when(F.col(index) < 0, F.uuid()).otherwise(F.lit(""))
    return marked.withColumn("_alone", alone).dropDuplicatesWithinWatermark([*key, "_alone"]).drop("_alone")


def windowed(stream: DataFrame, time: str, late: str, width: str, slide: str | None, by: list[str], x: str) -> DataFrame:
    """Counts and means per event-time window and group."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(span, *by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))


def moving_means(stream: DataFrame, task: str, order: str, x: str, alpha: float) -> DataFrame:
    """(task, n, ema) updates: keyed state (n, ema), restored from the checkpoint; the values of a batch are one weighted sum in their order."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        parts = [(b["o"].to_numpy(), b["x"].to_numpy(float)) for b in batches]
        x = np.concatenate([p[1] for p in parts])[np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")]
        if len(x):
            weight = alpha ** np.arange(len(x) - 1, -1, -1.0)
            share = np.full(len(x), 1 - alpha)
            share[0] = 1.0 if n == 0 else share[0]
            odd = ~np.isfinite(x)  # they stay, whatever their weight
            ema = (alpha ** len(x) * ema if np.isfinite(ema) else ema) * (n > 0) + float((weight * share)[~odd] @ x[~odd]) + float(x[odd].sum())
            n += len(x)
        state.update((n, float(ema)))
        yield pd.DataFrame({"task": [key[0]], "n": [n], "ema": [float(ema)]})

    rows = stream.select(F.col(task).alias("task"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"))
    return rows.groupBy("task").applyInPandasWithState(update, "task string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch to a folder of its own number, so a repeated batch replaces itself; ends when input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
