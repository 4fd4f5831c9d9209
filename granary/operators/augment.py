"""Corrupted variants: seeded attempts, first success with reason codes, best of N towards a target similarity, rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.training import uniform

#: Fixed value: attempts step their seed by this, so that seeds agree with existing data sets.
SEED_STEP = 7919


def attempts(rows: DataFrame, tries: int, seed: int = 42) -> DataFrame:
    """``tries`` rows of each row with ``attempt`` and ``seed``; seeded by attempt, so the result doesn't depend on partitions."""
    out = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    return out.withColumn("seed", F.lit(seed) + F.col("attempt") * SEED_STEP)


def first_success(tried: DataFrame, key: str, reason: Column, result: Column) -> DataFrame:
    """(key, reason, result, n): the first attempt whose reason is ``ok``; without one a null result and the last reason."""
    ok = reason == "ok"
    best = F.min_by(F.struct(reason.alias("reason"), F.when(ok, result).alias("result"), (F.col("attempt") + 1).alias("n")), F.struct(~ok, F.when(ok, F.col("attempt")).otherwise(-F.col("attempt"))))
    return tried.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def best_of(tried: DataFrame, key: str, similarity: Column, result: Column, target: float, tolerance: float) -> DataFrame:
    """(key, result, similarity, in_band, n): the first attempt within the band, else the closest one; earlier attempts win ties."""
    gap = F.abs(similarity - target)
    inside = gap <= tolerance + 1e-12
    rank = F.struct(~inside, F.when(inside, 0.0).otherwise(gap), F.col("attempt"))
    best = F.min_by(F.struct(result.alias("result"), similarity.alias("similarity"), inside.alias("in_band"), (F.col("attempt") + 1).alias("n")), rank)
    return tried.where(similarity.isNotNull()).groupBy(key).agg(best.alias("b")).select(key, "b.*")


def variants(tried: DataFrame, key: str, corrupt: Callable[[Column, Column], Column], source: Column) -> DataFrame:
    """(key, variants): the corrupted forms of every attempt, in order."""
    made = F.struct("attempt", corrupt(source, F.col("seed")).alias("v"))
    return tried.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(made)), lambda x: x.v).alias("variants"))


def drop_words(words: Column, seed: Column, ratio: float) -> Column:
    """Words without those that the seed picks; the stand-in for a structural corruption."""
    return F.filter(words, lambda w: uniform(seed, w) >= ratio)


def overlap(a: Column, b: Column) -> Column:
    """Shared by distinct elements of two arrays."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def rebuild_user_part(prompt: Column, instruction: Column, opening: str = "[INST] ", closing: str = " [/INST]") -> Column:
    """A prompt with its user part replaced and its graph block kept; unchanged where it has no user part."""
    pattern = rf"(?s)^(.*?\Q{opening}\E.*?\n\n)(.*?)(\Q{closing}\E.*)$"
    graph = F.regexp_extract(prompt, "(?s)(<GRAPH>.*?</GRAPH>)", 1)
    return F.when(prompt.rlike(pattern), F.concat(F.regexp_extract(prompt, pattern, 1), instruction, graph, F.regexp_extract(prompt, pattern, 3))).otherwise(prompt)
