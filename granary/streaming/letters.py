"""Aggregates off the writer's path: batches that fail are set aside with their error and the stream goes on."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from granary.sources.sinks import exists, remove

BATCHES = "query string, batch long, rows long, seconds double"


class Recorder(StreamingQueryListener):
    """What each micro-batch of any query read and took; the last ``most`` are kept."""

    def __init__(self, most: int = 10_000):
        self.batches: deque = deque(maxlen=most)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append((str(p.name or p.id), p.batchId, p.numInputRows, p.batchDuration / 1000.0))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.batches), BATCHES)


def guarded(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, name: str | None = None):
    """Start a query that writes ``aggregate`` of each batch to ``path/done``, or the batch itself with its error to ``path/dead``.

    A batch is in one of the two: both are written under the batch's number, and a batch that is run again after a restart first
    clears what it left, so nothing is counted twice. Errors of the dead-letter write itself stop the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()  # the source is read once, whichever way it goes
        try:
            remove(spark, f"{path}/dead/batch={number}")
            aggregate(kept).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        except Exception as e:  # noqa: BLE001
            remove(spark, f"{path}/done/batch={number}")
            said = str(e).splitlines()[0][:1000] if str(e) else type(e).__name__
            kept.withColumn("_error", F.lit(said)).write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def letters(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of ``done`` or ``dead`` batches with their number; none where no batch went that way."""
    at = f"{path}/{kind}"
    if not exists(spark, at):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", at).parquet(at)


def again(spark: SparkSession, path: str, schema: str, aggregate: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Run the aggregate over batches that were set aside, each for itself; the numbers of those that now went through."""
    through = []
    numbers = sorted(r["batch"] for r in letters(spark, path, "dead", schema).select("batch").distinct().collect())
    for n in numbers:
        rows = letters(spark, path, "dead", schema).where(F.col("batch") == n).drop("batch")
        try:
            aggregate(rows).write.mode("overwrite").parquet(f"{path}/done/batch={n}")
        except Exception:  # noqa: BLE001, S112
            remove(spark, f"{path}/done/batch={n}")
            continue
        remove(spark, f"{path}/dead/batch={n}")
        through.append(n)
    return through
