"""Splits by whole groups under quotas, as chemistry's scaffold splits are made."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ranks import numbered
from granary.sources.shared import stored


def quotas(sizes: list[tuple[int, int]], total: int, train: float, val: float) -> list[tuple[int, int, int]]:
    """(size, groups) from the largest size on -> (size, how many go to train, how many of the next to val).

    Group by group, a group goes to train if it fits there, else to val if it fits into both together, else to test. Groups of one size
    behave alike, so each size is one step.
    """
    out, in_train, in_val = [], 0, 0
    first, both = train * total, (train + val) * total
    for size, groups in sizes:
        a = max(0, min(groups, math.floor((first - in_train) / size + 1e-9)))
        in_train += a * size
        b = max(0, min(groups - a, math.floor((both - in_train - in_val) / size + 1e-9)))
        in_val += b * size
        out.append((size, a, b))
    return out


def split_groups(rows: DataFrame, key: str, order: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``rows`` with ``split``: whole groups of ``key``, the largest first (of equal size the one whose first ``order`` is later), fill train, then val, then test.

    Only counts of group sizes reach the driver: N rows have fewer than the root of 2 N different sizes. Groups are placed among those of
    their size by ranges, and rows meet their group's split in a join, so neither many groups nor a large one is one task's work. Rows
    without a key are one group.
    """
    groups = stored(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_size"), F.min(order).alias("_first")))
    counted = groups.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()
    plan = quotas([(r["_size"], r["n"]) for r in counted], sum(r["_size"] * r["n"] for r in counted), train, val)
    told = rows.sparkSession.createDataFrame(plan, "_of long, _train long, _val long")
    placed = numbered(groups, ["_size"], [F.desc("_first"), F.desc("_key")], place="_place").join(told, F.col("_size") == F.col("_of"))
    split = F.when(F.col("_place") <= F.col("_train"), "train").when(F.col("_place") <= F.col("_train") + F.col("_val"), "val").otherwise("test")
    marked = stored(placed.select("_key", split.alias("split")))
    return rows.join(marked, F.col(key).eqNullSafe(F.col("_key"))).select(*rows.columns, "split")
