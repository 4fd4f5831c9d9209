"""Evaluation aggregates by group: classification, regression, text, preference and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.ranks import numbered
from granary.operators.texts import text_scores
from granary.sources.shared import stored

NAN = float("nan")


def classification(rows: DataFrame, by: list[str], label: Column, p_false: Column, p_true: Column) -> DataFrame:
    """Per group: n, accuracy, precision, recall, f1, roc_auc, failure_rate; null labels are failures.

    AUC is the mid-rank statistic. Ranks come from counts per score: sums of 4,096 ranges of scores first, then running sums inside a
    range, so no task orders the scores of a whole group; a group without both labels has NaN, one without valid rows has NaN throughout. Ties of the two probabilities count as False.
    """
    base = rows.select(*by, label.cast("int").alias("y"), (p_true > p_false).cast("int").alias("p"), p_true.alias("s"))
    one = F.lit(1)
    told = base.groupBy(*by).agg(
        F.count(one).alias("n"), F.count("y").alias("valid"), F.count_if(F.expr("y = p")).alias("right"),
        F.count_if(F.expr("y = 1 and p = 1")).alias("tp"), F.count_if(F.expr("y = 0 and p = 1")).alias("fp"), F.count_if(F.expr("y = 1 and p = 0")).alias("fn"),
    )
    scores = base.where("y is not null").groupBy(*by, "s").agg(F.count_if(F.expr("y = 1")).alias("pos"), F.count_if(F.expr("y = 0")).alias("neg"))
    scores = scores.withColumn("range", F.floor(F.col("s") * 4096))
    upto = lambda *keys: F.coalesce(F.sum("neg").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = scores.groupBy(*by, "range").agg(F.sum("neg").alias("neg")).select(*by, "range", upto(*by, "range").alias("lower"))
    placed = scores.withColumn("inside", upto(*by, "range", "s")).join(ranges, [*by, "range"]).withColumn("below", F.col("lower") + F.col("inside"))
    auc = placed.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    safe = lambda a, b: F.when(F.col("valid") == 0, NAN).otherwise(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return told.join(auc, by, "left").select(
        *by, "n", safe(F.col("right"), F.col("valid")).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"), F.coalesce("auc", F.lit(NAN)).alias("roc_auc"), (1 - F.col("valid") / F.col("n")).alias("failure_rate"),
    )


def regression(rows: DataFrame, by: list[str], label: Column, prediction: Column) -> DataFrame:
    """Per group: n, mae, mse, rmse, failure_rate; a null on either side is a failure; without valid rows the errors are infinite."""
    ok = label.isNotNull() & prediction.isNotNull()
    gap = F.when(ok, label - prediction)
    inf = F.lit(float("inf"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.avg(F.abs(gap)), inf).alias("mae"), F.coalesce(F.avg(gap * gap), inf).alias("mse"),
        F.coalesce(F.sqrt(F.avg(gap * gap)), inf).alias("rmse"), (F.count_if(~ok) / F.count("*")).alias("failure_rate"),
    )


def corpus_bleu(rows: DataFrame, by: list[str], most: int = 4) -> DataFrame:
    """(by, bleu): corpus BLEU x 100 of rows (by, ref, hyp word arrays); sums first, then the geometric mean, no smoothing."""
    return text_scores(rows, by, (most,), (), False).select(*by, F.col(f"bleu{most}").alias("bleu"))


def rouge_n(rows: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """(by, rouge): mean over rows (ref, hyp word arrays) of the n-gram F score x 100."""
    return text_scores(rows, by, (), (n,), False).select(*by, F.col(f"rouge{n}").alias("rouge"))


def rouge_l(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rouge): mean F score of longest common subsequences x 100 of rows (ref, hyp word arrays)."""
    return text_scores(rows, by, (), (), True).select(*by, F.col("rouge_l").alias("rouge"))


def preference(rows: DataFrame, task: str, chosen: Column, rejected: Column) -> DataFrame:
    """Per task and overall (null task): accuracy, r_w, r_l, margin, n; the overall mean weighs rows alike."""
    base = rows.select(task, chosen.alias("w"), rejected.alias("l")).withColumn("m", F.col("w") - F.col("l"))
    return base.rollup(task).agg(F.avg((F.col("m") > 0).cast("double")).alias("accuracy"), F.avg("w").alias("r_w"), F.avg("l").alias("r_l"), F.avg("m").alias("margin"), F.count("*").alias("n"))


def summary(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, mean, population std, min, quartiles by linear interpolation, p90 and max; nulls count nothing.

    Quantiles are read off the places of the ordered rows, which are counted over ranges, so no task holds the values of a group.
    """
    known = stored(rows.select(*by, F.col(x).cast("double").alias("_x")).where("_x is not null"))
    told = known.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    sizes = told.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)], F.col("n").alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{k}"))
    quantiles = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    below = {q: F.floor((F.col("_n") - 1) * share) + 1 for q, share in quantiles.items()}
    over = {q: (F.col("_n") - 1) * share - F.floor((F.col("_n") - 1) * share) for q, share in quantiles.items()}
    placed = numbered(known, by, [F.col("_x")], place="_k").join(F.broadcast(sizes) if not by else sizes, same)
    near = placed.where(F.greatest(*[F.col("_k").isin(below[q], below[q] + 1).cast("int") for q in quantiles]) == 1)
    part = lambda q: F.when(F.col("_k") == below[q], F.col("_x") * (1 - over[q])).when((F.col("_k") == below[q] + 1) & (over[q] > 0), F.col("_x") * over[q])
    found = near.groupBy(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)]).agg(*[F.sum(part(q)).alias(q) for q in quantiles])
    return told.join(found, same).select(*by, "n", "mean", "std", "min", "p25", "median", "p75", "p90", "max")


def histogram(rows: DataFrame, x: Column, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, n): right-open bins with open ends; empty bins are kept."""
    spark = rows.sparkSession
    bounds = [None, *edges, None]
    bins = spark.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1)], "bin int, lo double, hi double")
    place = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = rows.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def trial_variance(rows: DataFrame, item: str, setting: str, x: str) -> DataFrame:
    """(setting, variance): mean over items of the unbiased variance over trials."""
    return rows.groupBy(item, setting).agg(F.var_samp(x).alias("v")).groupBy(setting).agg(F.avg("v").alias("variance"))


def packed_signs(v: Column) -> Column:
    """The signs of a whole vector as an array of longs, 60 components each."""
    word = lambda w: F.aggregate(F.slice(v, w * 60 + 1, 60), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 60).cast("int")), word)).otherwise(F.array().cast("array<long>"))


def _bits(a: Column, b: Column, how: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(getattr(x, how)(y))), F.lit(0).cast("long"), lambda n, k: n + k)


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of longs: bits of both over bits of either."""
    return _bits(a, b, "bitwiseAND") / F.nullif(_bits(a, b, "bitwiseOR"), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return _bits(a, b, "bitwiseXOR")
