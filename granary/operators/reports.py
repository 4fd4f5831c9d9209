"""What reports take from runs: values under several key layouts, means by slices, columns by kind of task, shares within a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.taxonomy import task_kind

# Strategies whose names carry a prefix in logged keys, and the prefixes, the newer first.
PREFIXED, PREFIXES = ("random", "semi_ar"), ("low_confidence_", "random_")
#: Metrics that a report shows for each kind of task.
SHOWN = {
    "classification": ["accuracy", "f1", "roc_auc", "failure_rate"],
    "regression": ["mae", "rmse", "failure_rate"],
    "molecule": ["validity", "exact_match", "levenshtein", "failure_rate"],
    "caption": ["bleu2", "bleu4", "rouge1", "rouge2", "rouge_l", "failure_rate"],
}


def key_layouts(dataset: Column, metric: Column, strategy: Column) -> Column:
    """The keys under which runs have logged a metric, in the order in which they are tried: dataset before metric and behind it, for each prefix."""
    out = []
    for k, prefix in enumerate(PREFIXES):
        name = F.when(strategy.isin(*PREFIXED), F.concat(F.lit(prefix), strategy))
        name = F.coalesce(name, strategy) if k == 0 else name  # others have no prefix, and are tried once
        out += [F.concat_ws("/", F.lit("val"), dataset, name, metric), F.concat_ws("/", F.lit("val"), metric, dataset, name)]
        out[-2:] = [F.when(name.isNotNull(), c) for c in out[-2:]]
    return F.array_compact(F.array(*out))


def lookup(wanted: DataFrame, summary: DataFrame) -> DataFrame:
    """(dataset, metric, strategy, value, key) of every wanted row: the first layout whose logged value is a number; nulls without one.

    ``summary`` is (key, value as text). Only the keys that are asked for are shuffled to the summary, which may be of any size.
    """
    asked = wanted.select("dataset", "metric", "strategy", F.posexplode(key_layouts(F.col("dataset"), F.col("metric"), F.col("strategy"))).alias("rank", "key"))
    logged = summary.select("key", F.col("value").try_cast("double").alias("value")).where("value is not null")
    first = asked.join(logged, "key").groupBy("dataset", "metric", "strategy").agg(F.min_by(F.struct("value", "key"), "rank").alias("found"))
    met = wanted.select("dataset", "metric", "strategy").distinct().join(first, ["dataset", "metric", "strategy"], "left")
    return met.select("dataset", "metric", "strategy", "found.value", "found.key")


def slice_means(rows: DataFrame, batch: str, task: str, values: list[str]) -> DataFrame:
    """(batch, task, n, values): means of every task's slice of a batch and, with a null task, of the whole batch; null values count nothing."""
    told = rows.rollup(batch, task).agg(F.grouping(batch).alias("_all"), F.grouping(task).alias("_whole"), F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    return told.where((F.col("_all") == 0) & ((F.col("_whole") == 1) | F.col(task).isNotNull())).drop("_all", "_whole")


def shown(rows: DataFrame, kind: str) -> DataFrame:
    """(task, strategy, metrics of the kind as columns) of a long (task, strategy, metric, value) table; metrics that a task has not are null."""
    return rows.where(task_kind(F.col("task")) == kind).groupBy("task", "strategy").pivot("metric", SHOWN[kind]).agg(F.first("value"))


def within(rows: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of at most ``most``, one row (n, kept, percent)); rows without a size are left out."""
    fits = F.coalesce(size <= most, F.lit(False))
    return rows.where(fits), rows.agg(F.count("*").alias("n"), F.count_if(fits).alias("kept"), (100 * F.count_if(fits) / F.nullif(F.count("*"), F.lit(0))).alias("percent"))


def toy_splits(rows: DataFrame, split: str, key: str, n: int | None) -> DataFrame:
    """The ``n`` rows of smallest md5 of the key of every split (all without n); a limit goes ahead of the shuffle, so no split is sorted whole."""
    if n is None:
        return rows
    place = F.row_number().over(Window.partitionBy(split).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
