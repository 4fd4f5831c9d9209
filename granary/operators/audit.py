"""Stage audits and dataset validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_table(stages: dict[str, DataFrame], by: str, split: str, splits: list[str]) -> DataFrame:
    """(by, <stage>_<split>..., drop_<stage>): counts of every stage and the drop from the stage before; 0 where that is empty."""
    parts = [df.groupBy(by, split).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, df in stages.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = list(stages)
    cells = [f"{n}_{s}" for n in names for s in splits]
    out = rows.withColumn("cell", F.concat_ws("_", "stage", split)).groupBy(by).pivot("cell", cells).agg(F.first("n")).na.fill(0)
    total = lambda n: sum((F.col(f"{n}_{s}") for s in splits), F.lit(0))
    drops = [F.when(total(a) > 0, total(a) - total(b)).otherwise(0).alias(f"drop_{b}") for a, b in zip(names, names[1:], strict=False)]
    return out.select("*", *drops)


def drop_cause(before: Column, after: Column, expected: float = 0.02, threshold: int = 10) -> Column:
    """Why a stage lost rows: nothing, all, about the expected share, a few, or many."""
    lost = before - after
    return (
        F.when(before == 0, "absent").when(lost == 0, "none").when(after == 0, "all").when(lost < 0, "grown")
        .when(F.abs(lost / before - expected) <= expected / 2, "expected").when(lost <= threshold, "few").otherwise("many")
    )


def expansion(before: Column, after: Column) -> Column:
    return F.when(before == 0, float("nan")).otherwise(after / before)


def validate(rows: DataFrame, checks: dict[str, Column], key: str, examples: int = 10) -> DataFrame:
    """(category, errors, examples): failed checks with the smallest keys; a null check counts as failed, unfailed ones show 0.

    Examples are the first few by rank, limited before they are shuffled; errors are counted apart, so no category is sorted whole.
    """
    spark = rows.sparkSession
    failed = rows.select(F.col(key).alias("k"), F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))).alias("category"))
    first = failed.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("k"))).where(F.col("r") <= examples)
    shown = first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("examples"))
    told = failed.groupBy("category").agg(F.count("*").alias("errors")).join(shown, "category")
    return spark.createDataFrame([(n,) for n in checks], "category string").join(told, "category", "left").select("category", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("examples", F.lit("")).alias("examples"))


def group_totals(rows: DataFrame, by: str, source: str) -> DataFrame:
    """Totals per group and Overall, with the group's sources joined by `` + ``."""
    one = rows.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(source)), " + ").alias("sources"))
    return one.unionByName(rows.agg(F.lit("Overall").alias(by), F.count("*").alias("n"), F.lit("").alias("sources")))
