"""Sinks: write-once, replace and per-group outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless a committed output is there; tells whether it wrote."""
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, move the old table aside, then the new one into its place; the old one goes last.

    Between the two moves nothing is at ``path``, but both tables are whole; ``recover`` ends a replacement that broke off.
    """
    df.write.mode("overwrite").parquet(f"{path}.new")
    _swap(df.sparkSession, path)


def recover(spark: SparkSession, path: str) -> None:
    """After a broken replacement: a committed new table takes its place, else the old one comes back."""
    if exists(spark, f"{path}.new/_SUCCESS"):
        _swap(spark, path)
    elif exists(spark, f"{path}.old") and not exists(spark, path):
        _move(spark, f"{path}.old", path)


def _swap(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        remove(spark, f"{path}.old")
        _move(spark, path, f"{path}.old")
    _move(spark, f"{path}.new", path)
    remove(spark, f"{path}.old")


def _move(spark: SparkSession, source: str, to: str) -> None:
    one, other = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, to))
    if not one.getFileSystem(spark._jsc.hadoopConfiguration()).rename(one, other):
        raise OSError(f"could not move {source} to {to}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; nothing where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as further JSON lines; each writer adds files of its own, so none waits for a lock."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, *needed: str) -> None:
    """Rows whose ``needed`` columns are neither null nor empty, as CSV with a header."""
    for c in needed:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    df.write.mode("overwrite").csv(path, header=True)


def write_predictions(df: DataFrame, path: str, epoch: float, step: int) -> None:
    """JSON lines with epoch and step, a folder for each ``part``: every task writes its own files."""
    df.withColumns({"epoch": F.lit(float(epoch)), "global_step": F.lit(step)}).write.mode("overwrite").partitionBy("part").json(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; fails on more than ``most`` rows instead of cutting them."""
    told = rows.limit(most + 1).collect()
    if len(told) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["-"] * len(rows.columns), *[[show(v) for v in r] for r in told]]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def write_splits(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_failures(df: DataFrame, failed, path: str, *by: str) -> None:
    """Failed rows as JSON, a folder per group."""
    df.where(failed).write.mode("overwrite").partitionBy(*by).json(path)
