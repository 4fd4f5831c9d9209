"""Evaluation leakage and within-family duplicates, by anti-joins on entity keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.shared import stored


def eval_keys(rows: DataFrame, group: str, include_validation: bool = True) -> DataFrame:
    """(group, key): distinct known keys of the evaluation splits."""
    splits = ["test", "val"] if include_validation else ["test"]
    return rows.where(F.col("split").isin(splits) & F.col("key").isNotNull()).select(group, "key").distinct()


def flag_leakage(rows: DataFrame, group: str, include_validation: bool = True) -> DataFrame:
    """``rows`` with ``leaked``: the key is in the group's evaluation splits; unknown keys never leak, nor do frozen splits.

    The key set grows with the data, so the join is left to Catalyst: adaptive execution broadcasts it while it is small.
    """
    keys = eval_keys(rows, group, include_validation).withColumn("_known", F.lit(True))
    open_splits = ["train"] if include_validation else ["train", "val"]
    return rows.join(keys, [group, "key"], "left").withColumn("leaked", F.coalesce("_known", F.lit(False)) & F.col("split").isin(open_splits)).drop("_known")


def remove_leakage(rows: DataFrame, group: str) -> DataFrame:
    """Train rows whose key isn't in the group's evaluation splits; null keys and duplicates inside train stay."""
    return rows.where("split = 'train'").join(eval_keys(rows, group), [group, "key"], "left_anti")


def flag_family_duplicates(rows: DataFrame, family: Column, loser: Column) -> DataFrame:
    """``rows`` with ``duplicated``: train rows of the losing task whose key an anchor task of the family has in train."""
    marked = rows.withColumn("_family", family).withColumn("_loser", loser)
    anchors = marked.where("split = 'train' and key is not null and _family is not null and not _loser").select("_family", "key").distinct().withColumn("_known", F.lit(True))
    out = marked.join(anchors, ["_family", "key"], "left")
    return out.withColumn("duplicated", F.coalesce("_known", F.lit(False)) & F.col("_loser") & (F.col("split") == "train")).drop("_family", "_loser", "_known")


def removals(rows: DataFrame, reason: Column) -> DataFrame:
    """(task, split, reason, removed) with totals at every level; null marks a total."""
    return rows.withColumn("reason", reason).where("reason is not null").rollup("task", "split", "reason").agg(F.count("*").alias("removed"))


def before_after(rows: DataFrame, gone: Column) -> DataFrame:
    """(task, split, before, after, removed) and a grand total."""
    counts = rows.groupBy("task", "split").agg(F.count("*").alias("before"), F.count_if(~gone).alias("after"))
    total = counts.agg(F.lit("TOTAL").alias("task"), F.lit("all").alias("split"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return counts.unionByName(total).withColumn("removed", F.col("before") - F.col("after"))


def _hashed(text: str) -> Column:
    """Two independent hashes of every word of a text; words are split by one space."""
    return F.transform(F.split(text, " "), lambda w: F.struct(F.xxhash64(F.lit(1), w).alias("h1"), F.xxhash64(F.lit(2), w).alias("h2")))


def _windows(words: Column, size: Column) -> Column:
    """Two hashes of every run of ``size`` hashed words, repeats included: an array of structs finds its repeats only pair by pair."""
    n = F.size(words) - size + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.slice(words, i, size))
    return F.transform(runs, lambda g: F.struct(F.xxhash64(F.lit(1), g).alias("h1"), F.xxhash64(F.lit(2), g).alias("h2")))


def containment(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """(item_id, n_docs): of (id, text) documents, how many hold any ``n`` words in a row of an item, or the whole of a shorter one; words are split by one space.

    Runs are 128-bit hashes of the hashes of their words, so a word is hashed once for all its runs. Those of the items are stored first:
    while their table is small by its size on disk, Spark sends it to the documents and no window of a document is shuffled; beyond that
    both sides are dealt by their hash. A document meets only the sizes that items have, ``n`` at most.
    """
    asked = items.select("item_id", _hashed("text").alias("w")).withColumn("k", F.least(F.size("w"), F.lit(n)))
    asked = stored(asked.select("item_id", "k", F.explode(_windows(F.col("w"), F.col("k"))).alias("g")).select("item_id", "k", "g.h1", "g.h2").distinct())
    sizes = F.broadcast(asked.select("k").distinct())  # n rows at most
    sized = docs.select("id", _hashed("text").alias("w")).crossJoin(sizes)
    held = sized.select("id", "k", F.explode(_windows(F.col("w"), F.col("k"))).alias("g")).select("id", "k", "g.h1", "g.h2")
    return held.join(asked, ["k", "h1", "h2"]).select("item_id", "id").distinct().groupBy("item_id").agg(F.count("*").alias("n_docs"))
