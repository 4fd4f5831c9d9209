"""Streams run to the end of their input; each agrees with a batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from granary.plans.common import Query, scratch
from granary.sources.tables import load
from granary.streaming import logs


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(load(spark, "events", sf).schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _ended(stream: DataFrame, mode: str) -> DataFrame:
    """The last output of a stream in the given mode, from the folders of its batches."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{at}/out").parquet(f"{at}/out")


def _dedup(s, d):
    rows = _events(s, d).withColumn("val_idx", F.when(F.col("event_id") % 50 == 0, -1).otherwise(F.col("user_id")))
    out = _ended(logs.deduplicated(rows, ["val_idx", "event_type"], "ts", "3650 days", "val_idx"), "append")
    return out.groupBy("val_idx", "event_type").agg(F.count("*").alias("n"))


def _windows(s, d):
    out = _ended(logs.windowed(_events(s, d), "ts", "1 hour", "6 hours", None, ["event_type"], "value"), "update")
    last = out.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "mean"), "batch").alias("r"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "r.n", F.round("r.mean", 9).alias("mean"))


def _ema(s, d):
    out = _ended(logs.moving_means(_events(s, d), "event_type", "event_id", "value", 0.9), "update")
    return out.groupBy(F.col("task").alias("event_type")).agg(F.max_by(F.struct("n", "ema"), "n").alias("r")).select("event_type", "r.n", F.round("r.ema", 4).alias("ema"))


QUERIES: dict[str, Query] = {
    "stream_dedup_first": (
        _dedup,
        """SELECT CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END AS val_idx, event_type, CASE WHEN min(CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END) < 0 THEN count(*) ELSE 1 END AS n FROM events GROUP BY 1, 2""",
    ),
    "stream_windows": (
        _windows,
        "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL",
    ),
    "stream_ema": (
        _ema,
        """SELECT event_type, any_value(n) AS n, round(sum(value * CASE WHEN k = 1 THEN 1.0 ELSE 0.1 END * pow(0.9::DOUBLE, n - k)), 4) AS ema
        FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""",
    ),
}
