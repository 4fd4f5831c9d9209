"""Deterministic sampling, replication and pairing: md5 order in place of random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.ranks import numbered


def hashed(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def _dealt(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """``df`` with its md5 order and that order's first digits: a group is 4,096 buckets in order, so none is sorted in one task."""
    return df.withColumn("_order", hashed(seed, F.col(key))).withColumn("_bucket", F.substring("_order", 1, 3))


def _back(dealt: DataFrame, told: DataFrame, group: str) -> DataFrame:
    """Rows beside what is told of their group and bucket; a null group is a group."""
    told = told.withColumnsRenamed({group: "_g", "_bucket": "_b"})
    return dealt.join(told, dealt[group].eqNullSafe(told["_g"]) & (dealt["_bucket"] == told["_b"])).drop("_g", "_b")


def per_group(df: DataFrame, group: str, n: Column, key: str, seed: int = 42) -> DataFrame:
    """The first n rows of each group in md5 order; ``n`` may use ``_total``, the group's size.

    Counts of buckets say which are taken whole; rows are ranked inside their bucket only.
    """
    dealt = _dealt(df, group, key, seed)
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_in"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_in").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.withColumn("_total", F.sum("_in").over(w)).withColumn("_left", n - before).where("_left > 0").select(group, "_bucket", "_left")
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_order", key))
    return _back(dealt, told, group).withColumn("_rank", rank).where("_rank <= _left").drop("_order", "_bucket", "_left", "_rank")


def stratified(df: DataFrame, group: str, ratio: int, floor: int, key: str, seed: int = 42) -> DataFrame:
    """One in ``ratio`` of each group, rounded half to even, at least ``floor``, at most all."""
    n = F.least(F.col("_total"), F.greatest(F.lit(floor), F.bround(F.col("_total") / ratio, 0).cast("long")))
    return per_group(df, group, n, key, seed)


def replicate(df: DataFrame, factor: int, templates: Column, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``factor`` copies of each row, each with a template chosen by hash; the original isn't kept besides."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", (F.lit(seed) + F.col("copy")).cast("string"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return copies.withColumn("template", F.element_at(templates, (F.pmod(digit, F.size(templates)) + 1).cast("int")))


def paired(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """(key, partner): each row of a group with the next in md5 order, round the end; rows alone in their group are left out."""
    dealt = _dealt(df, group, key, seed)
    w = Window.partitionBy(group).orderBy("_bucket")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = dealt.groupBy(group, "_bucket").agg(F.min(F.struct("_order", key))[key].alias("_key"))
    told = firsts.select(group, "_bucket", F.coalesce(F.lead("_key").over(w), F.first("_key").over(whole)).alias("_next"))
    after = F.lead(key).over(Window.partitionBy(group, "_bucket").orderBy("_order", key))
    return _back(dealt, told, group).withColumn("partner", F.coalesce(after, "_next")).where(F.col("partner") != F.col(key)).select(group, key, "partner")


def sharded(rows: DataFrame, order: str, world: int, batch: int) -> DataFrame:
    """``rows`` with ``rank``, ``turn`` and ``missed``: dealt in turn to ``world`` readers that pad to equal shares and leave out what doesn't fill a batch.

    The first rows fill up the last turn again, so a row is missed only if none of its places is in a whole batch. Places come from
    ``ranks.numbered``, so the table is never sorted in one task.
    """
    placed = numbered(rows, [], [F.col(order)], place="_place").withColumn("_place", F.col("_place") - 1)
    total = rows.count()
    per = -(-total // world)
    whole = per // batch * batch
    turn = F.floor(F.col("_place") / world)
    padded = (F.col("_place") + total < per * world) & (F.floor((F.col("_place") + total) / world) < whole)
    return placed.select(*rows.columns, (F.col("_place") % world).cast("int").alias("rank"), turn.alias("turn"), (~((turn < whole) | padded)).alias("missed"))


def split_off(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Rows with ``split``: val for the least ``share`` of md5 orders (rounded half to even), else train; exact counts, no global sort.

    Every row gets its mark once, also where keys repeat: buckets before the share's end are val and those behind it train, and only rows
    of the bucket in between are ranked.
    """
    dealt = _dealt(df, "", key, seed)
    w = Window.orderBy("_bucket")  # 4,096 rows at most
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_in"))
    n = F.bround(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share, 0).cast("long")
    before = F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.select(F.col("_bucket").alias("_b"), "_in", (n - before).alias("_left"))
    placed = dealt.join(told, F.col("_bucket") == F.col("_b"))
    whole = placed.where("_left <= 0 or _left >= _in").withColumn("split", F.when(F.col("_left") > 0, "val").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", key))
    cut = placed.where("_left > 0 and _left < _in").withColumn("split", F.when(rank <= F.col("_left"), "val").otherwise("train"))
    return whole.unionByName(cut).select(*df.columns, "split")


def with_copies(df: DataFrame, name: str, names: list[str], factor: int, templates: Column, key: str, seed: int = 42) -> DataFrame:
    """Rows of other names once, and exactly ``factor`` copies of the rows of ``names``."""
    chosen = F.coalesce(F.col(name).isin(names), F.lit(False))
    return df.where(~chosen).withColumns({"copy": F.lit(0), "template": F.lit(None).cast("string")}).unionByName(replicate(df.where(chosen), factor, templates, key, seed))
