"""Places and running sums over whole ordered groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.shared import stored


def numbered(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, place: str = "place", ranges: bool = False) -> DataFrame:
    """``rows`` with ``place`` (from 1) in its group and running ``sums`` up to and with the row.

    Rows are cut into ranges of (group, order), stored, since ranges are drawn anew by every job; inside a range rows are counted by
    a window, and what comes before is told by the ranges of the group, of which there are no more than shuffle partitions. A group of
    many rows is many ranges. Rows of equal order get some order of their own; null groups are groups. With ``ranges`` each row's range
    and the places before it come along as ``_part`` and ``_before``.
    """
    sums = sums or {}
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    # the last key parts rows that are equal in all others, so that no range is one repeated row
    salted = rows.withColumn("_salt", F.rand(7))
    dealt = stored(salted.repartitionByRange(width, *keys, *order, "_salt").drop("_salt").withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_before"), *[F.sum(x).alias(f"_before_{c}") for c, x in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)], F.col("_part").alias("_of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in totals.columns[len(by) + 1 :]])
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.withColumns({"_place": F.row_number().over(within), **{f"_sum_{c}": F.sum(x).over(upto) for c, x in sums.items()}})
    same = F.col("_part") == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{k}"))
    return told.join(before, same).select(*rows.columns, *["_part", "_before"] * ranges, (F.col("_place") + F.col("_before")).alias(place), *[(F.col(f"_sum_{c}") + F.col(f"_before_{c}")).alias(c) for c in sums])
