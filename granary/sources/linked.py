"""Datasets whose splits may be files of another dataset: a subset writes its own split and refers to the others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from granary.sources.sinks import exists, remove
from granary.sources.stages import listing, read_text, write_text

LIST = "splits.json"


def splits_of(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Split -> its data files: those that the dataset's list names, else those of each folder."""
    text = read_text(spark, f"{root}/{LIST}")
    if text is not None:
        return json.loads(text)
    found: dict[str, list[str]] = {}
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    folders = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
    for f in folders:
        if f.isDirectory():
            files = [name for name, _, _ in listing(spark, f.getPath().toString()) if not name.rpartition("/")[2].startswith(("_", "."))]
            if files:
                found[f.getPath().getName()] = files
    return found


def link_subset(source: str, target: str, split: str, rows: DataFrame) -> dict[str, list[str]]:
    """Write ``rows`` as the ``split`` of ``target`` and refer to the files of all other splits of ``source``; no file of these is copied.

    The list is written last: a subset that broke off has none, and isn't read as a dataset.
    """
    spark = rows.sparkSession
    known = splits_of(spark, source)
    if split not in known:
        raise ValueError(f"{source} has no split {split}")
    if exists(spark, f"{target}/{LIST}"):
        remove(spark, f"{target}/{LIST}")
    rows.write.mode("overwrite").parquet(f"{target}/{split}")
    own = [name for name, _, _ in listing(spark, f"{target}/{split}") if name.endswith(".parquet")]
    told = {k: v for k, v in known.items() if k != split} | {split: own}
    write_text(spark, f"{target}/{LIST}", json.dumps(told))
    return told


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """The rows of a split, wherever its files are; a referred file that is gone fails the read."""
    known = splits_of(spark, root)
    if split not in known:
        raise ValueError(f"{root} has no split {split}")
    return spark.read.parquet(*known[split])


def remove_subset(spark: SparkSession, target: str) -> None:
    """Delete the subset's own files and list; what it refers to stays."""
    remove(spark, target)
