"""Helpers shared by the training-data operators: shared scratch tables and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.shared import cleaned


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset in local mode (tests) a local one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        at = getattr(spark.sparkContext, "_granary_scratch", None)
        if at is None:
            at = tempfile.mkdtemp(prefix="granary-")
            spark.sparkContext._granary_scratch = at
    return at.rstrip("/")


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes: batches are of whole texts, of any length. A smaller bound of the session's own stays."""
    bound = spark.conf.get(BATCH)
    if not bound.rstrip("b").isdigit() or int(bound.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; cuts lineage, survives lost executors.

    Shuffle files of the write go as soon as it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._granary_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a filter at most (16 MB); with more keys more rows pass that have none.
FILTER = 1 << 27


def key_filter(keys: DataFrame) -> np.ndarray:
    """The bits of the hashes in the one column (long) of ``keys``: some 16 a key, ``FILTER`` at most, made by Spark's bitmap aggregates."""
    hashed = keys.toDF("key")
    size = min(FILTER, max(1 << 15, 1 << (16 * hashed.count()).bit_length()))
    place = F.pmod("key", F.lit(size)) + 1
    found = hashed.select(F.bitmap_bucket_number(place).alias("at"), F.bitmap_bit_position(place).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros((size >> 15, 4096), np.uint8)
    for at, bits in zip(found["at"].to_pylist(), found["bits"], strict=True):
        out[at - 1] = np.frombuffer(bits.as_py(), np.uint8)
    return out.ravel()


def maybe_in(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """False only for hashes that no key of the filter has."""
    place = hashed.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
