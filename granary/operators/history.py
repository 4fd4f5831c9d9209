"""Logs and histories: merging, nearest and best rows, runs, moving means, prefix sums."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import ranks
from granary.sources.shared import stored


def merge_first(rows: DataFrame, key: list[str], order: list[str], index: str) -> DataFrame:
    """The first row of each key in order; rows whose ``index`` is negative have no identity and all stay."""
    w = Window.partitionBy(*key).orderBy(*order)
    keyed = rows.where(F.col(index) >= 0).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return keyed.unionByName(rows.where(F.col(index) < 0))


def nearest(rows: DataFrame, at: Column, target: float, order: str) -> DataFrame:
    """The row whose value is nearest to the target; the first in order wins ties, nulls are skipped."""
    return rows.where(at.isNotNull()).orderBy(F.abs(at - target), order).limit(1)


def first_best(rows: DataFrame, by: list[str], value: Column, order: str, columns: list[str]) -> DataFrame:
    """Per group the first row of the greatest value; nulls and NaN are skipped."""
    fields = F.struct(*columns)
    return rows.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.max_by(fields, F.struct(value, -F.col(order))).alias("r")).select(*by, "r.*")


def first_match(rows: DataFrame, condition: Column, order: str) -> DataFrame:
    return rows.where(condition).orderBy(order).limit(1)


def moving_mean(rows: DataFrame, task: str, order: list[str], x: str, alpha: float) -> DataFrame:
    """(task, n, ema): v = alpha v + (1 - alpha) x over all ordered rows; the first value starts it.

    The fold is a sum of all values with weights alpha^(n-k); places k come from ``ranks.numbered``, so no task sorts a whole group.
    Infinite values stay, as in a fold, and null values are skipped.
    """
    placed = ranks.numbered(rows.where(F.col(x).isNotNull()).select(task, *dict.fromkeys([*order, x])), [task], [F.col(c) for c in order], place="_k")
    sizes = placed.groupBy(F.col(task).alias("_task")).agg(F.count("*").alias("n"))
    weight = F.when(F.col("_k") == 1, 1.0).otherwise(1 - alpha) * F.pow(F.lit(alpha), F.col("n") - F.col("_k"))
    value = F.when(F.abs(x) == float("inf"), F.col(x)).otherwise(weight * F.col(x))
    return placed.join(sizes, F.col(task).eqNullSafe(F.col("_task"))).groupBy(task).agg(F.first("n").alias("n"), F.sum(value).alias("ema"))


def running_mean(rows: DataFrame, task: str, order: list[str], x: str, alpha: float) -> DataFrame:
    """``rows`` with ``ema``: the moving mean of their task after each of them, in order; the first value starts it.

    A range of a task is folded from zero where it lies, a row at a time; what the ranges before it bring is a fold over their ends,
    of which a task has no more than there are shuffle partitions. So the longest chain is a range, not a task. Values must not be null.
    """
    placed = stored(ranks.numbered(rows, [task], [F.col(c) for c in order], place="_place", ranges=True))
    names = placed.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)

    def fold(batches):
        key, value = None, 0.0
        for b in batches:
            out = []
            for t, part, place, v in zip(*(b.column(c).to_pylist() for c in (task, "_part", "_place", x)), strict=True):
                if (t, part) != key:
                    key, value = (t, part), 0.0
                value = v if place == 1 else alpha * value + (1 - alpha) * v
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*names, "_local"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = placed.repartition(width, task, "_part").sortWithinPartitions(task, "_part", "_place")
    local = stored(whole.mapInArrow(fold, f"{kinds}, _local double"))
    ends = local.groupBy(F.col(task).alias("_t"), F.col("_part").alias("_p")).agg(F.count("*").alias("n"), F.max_by("_local", "_place").alias("end"))
    earlier = Window.partitionBy("_t").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    told = F.array_sort(F.collect_list(F.struct("_p", "n", "end")).over(earlier))
    carried = ends.select("_t", "_p", F.aggregate(told, F.lit(0.0), lambda a, p: F.pow(F.lit(alpha), p["n"]) * a + p["end"]).alias("_carry"))
    met = local.join(carried, F.col(task).eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_local") + F.pow(F.lit(alpha), F.col("_place") - F.col("_before")) * F.col("_carry")).alias("ema"))


def flushed_means(rows: DataFrame, by: list[str], step: Column, every: int, x: str) -> DataFrame:
    """Means per tumbling window of steps; the last window may be short."""
    return rows.groupBy(*by, F.floor(step / every).cast("long").alias("flush")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))


def contiguous(rows: DataFrame, scope: str, value: str, order: str) -> DataFrame:
    """(value, runs, contiguous): in how many runs of the ordered rows of a scope each value appears.

    Rows are placed over ranges, and each meets the one before it by its place, so a scope isn't one task's work.
    """
    placed = stored(ranks.numbered(rows.select(scope, value, order), [scope], [F.col(order)], place="_k"))
    before = placed.select(F.col(scope).alias("_s"), F.col(value).alias("_v"), (F.col("_k") + 1).alias("_next"))
    met = placed.join(before, F.col(scope).eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_next")), "left")
    starts = met.withColumn("_starts", (F.col("_next").isNull() | ~F.col("_v").eqNullSafe(F.col(value))).cast("int"))
    return starts.groupBy(scope, value).agg(F.sum("_starts").alias("runs")).withColumn("contiguous", F.col("runs") == 1)


def ordinal(rows: DataFrame, scope: str, order: str, flag: Column) -> DataFrame:
    """Rows with the ordinal from 0 among flagged rows of the scope; null where the flag is off."""
    told = ranks.numbered(rows.withColumn("_flag", flag.cast("int")), [scope], [F.col(order)], {"_upto": F.col("_flag")}, "_k")
    return told.withColumn("ordinal", F.when(F.col("_flag") == 1, F.col("_upto") - 1)).drop("_flag", "_upto", "_k")


def top_k(rows: DataFrame, scope: str, value: str, tie: str, k: int) -> DataFrame:
    """The k greatest of each scope."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(value), tie))).where(F.col("rank") <= k)


def padded_history(rows: DataFrame, epoch: str, order: str, name: str, names: list[str], value: str) -> DataFrame:
    """One row per epoch and a column per name; the last of an epoch wins, missing ones are NaN."""
    last = rows.groupBy(epoch, name).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(epoch).pivot(name, names).agg(F.first("v")).na.fill(float("nan"))


def outer_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, before, after, delta, ok): full outer join of two (key, n) tables; missing counts are 0."""
    a, b = left.select(key, F.col("n").alias("before")), right.select(key, F.col("n").alias("after"))
    out = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("ok", F.col("delta") == 0)
