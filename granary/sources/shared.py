"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING = threading.Lock()
_writers: dict[int, list] = {}
_made = threading.local()


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder where it is unset in local mode, and an error elsewhere."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        at = tempfile.mkdtemp(prefix="granary-")
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/queries/{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files go with the query that made them; the session's own setting comes back with the last of its writers."""
    with _WRITING:
        held = _writers.setdefault(id(spark), [0, spark.conf.get(CLEANUP, None)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _WRITING:
            held[0] -= 1
            if not held[0]:
                del _writers[id(spark)]
                spark.conf.set(CLEANUP, held[1]) if held[1] is not None else spark.conf.unset(CLEANUP)


@contextmanager
def gathered():
    """The list of the tables that this thread stores inside, so that they can be discarded together."""
    outer, _made.tables = getattr(_made, "tables", None), []
    try:
        yield _made.tables
    finally:
        _made.tables = outer


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, and its rows don't change when they are read twice.

    Shuffle files of the write go as soon as it is done: nothing reads them again.
    """
    at = scratch(df.sparkSession)
    with cleaned(df.sparkSession):
        df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._granary_path = at
    if getattr(_made, "tables", None) is not None:
        _made.tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._granary_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
