"""Mixing sources to target weights: hash-random keys, ranges within each source, prefix sums of sizes, a cut at the exact budget.

A source's target is its share by weight of all sizes, at most ``most`` times its own size; what goes beyond is shared again by
weight among the others until none is over. With the sources in order of size over weight the full ones come first, so two prefix
sums over sources give all targets at once.

Every document has a random key, the md5 of seed, id and size: the same on every run and partitioning. Key ranges of equal width
(their number grows with the square root of the rows) are summed with map-side combine, the sums of a source are prefix-summed, and
the range where its budget ends is sorted by key and summed row by row; all ranges before it are whole. So the documents are
taken in the order of a full sort, but only one range of each source is ever sorted. A budget beyond the source's size takes
every document that many times, and the rest of the budget once more from the front. The document at the cut gives the words that
are left. Sources are numbered and summed by ranges of their own order (``ranked``), so many sources aren't one task either.

Cases: null and empty texts have size 0 and are taken 0 times; without any word all targets are 0. A null source is a source of
its own, the last. Rows of equal id, source and size are one draw: each gets the same number of words, so a cut among c copies may leave
out fewer than c words; a null id is an id like any other. Ties of keys are ordered by id and size. Very long texts are counted where
they lie, without a list of their words. Only the three named columns are read, so others never clash. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import shuffle_width, stored

WEIGHTS, MOST = (5, 2, 1), 3
SPACE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space; null has none."""
    marked = F.regexp_replace(F.ltrim(text, F.lit(SPACE)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")
    return F.coalesce(F.length(marked), F.lit(0)).cast("long")


def ranked(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with ``place`` (from 0 in ``order``) and running ``sums`` over the rows up to and with each.

    Range partitions are stored first, since their bounds are drawn anew by every job; only one row of each meets in a task.
    """
    dealt = stored(rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), name)
    totals = dealt.groupBy("part").agg(F.count("*").alias("before"), *[F.sum(x).alias(f"before_{c}") for c, x in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in totals.columns[1:]]), f"{name}_parts")
    within = Window.partitionBy("part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.withColumns({"place": F.row_number().over(within) - 1, **{c: F.sum(x).over(upto) for c, x in sums.items()}}).join(before, "part")
    return told.select(*rows.columns, (F.col("place") + F.col("before")).alias("place"), *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in sums])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): weights go round the sources in code point order, null last."""
    placed = ranked(sources.select("source", "source_size"), [F.asc_nulls_last("source")], {}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(placed.select("source", "source_size", weight.cast("decimal(38,0)").alias("weight")), "weighed")
    size = F.col("source_size").cast("decimal(28,0)")
    total, whole = weighed.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # the level at which a source is full is most * size / weight; it is full if that level over all sources doesn't reach the total
    filled = ranked(weighed, [(F.col("source_size") / F.col("weight")).asc(), F.asc_nulls_last("source")], {"full_size": size, "full_weight": F.col("weight")}, "levels").withColumns(
        {"full_size": F.col("full_size").cast("double"), "full_weight": F.col("full_weight").cast("double"), "w": F.col("weight").cast("double"), "z": size.cast("double")}
    )
    level = most * (F.col("w") * F.col("full_size") + F.col("z") * (float(whole) - F.col("full_weight")))
    marked = stored(filled.withColumn("full", level < F.col("w") * float(total)), "filled")
    taken, used = marked.where("full").agg(F.coalesce(F.sum(most * F.col("z")), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    rest, left = float(total) - taken, float(whole) - used
    share = F.lit(rest) * F.col("w") / F.lit(left) if left else F.lit(0.0)
    return marked.select("source", "source_size", F.when(F.col("full"), most * F.col("z")).otherwise(F.least(share, most * F.col("z"))).alias("target"))


def random_key(seed: int, id_: Column, size: Column) -> Column:
    """60 random bits of the id and size."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), size.cast("string"))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 13) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row: how many of its words the mix takes, repeats counted."""
    named = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    sized = stored(named.withColumn("key", random_key(seed, F.col("id"), F.col("size"))), "sized")
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    goals = targets(sources, weights, most)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = goals.select(F.col("source").alias("of"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    rows = sources.agg(F.sum("n")).first()[0] or 0
    digits = max(0, min(30, (int(rows).bit_length() + 1) // 2 - 3))
    range_ = F.shiftright("key", 60 - digits)

    # the range of each source where the rest of its budget ends
    in_order = Window.partitionBy("source").orderBy("range")
    ranges = sized.groupBy("source", range_.alias("range")).agg(F.sum("size").alias("within")).withColumn("upto", F.sum("within").over(in_order))
    plan = stored(plan, "plan")
    same = F.col("source").eqNullSafe(F.col("of"))
    cut = ranges.join(plan, same).where("upto - within <= rest and rest < upto").select("of", F.col("range").alias("cut"), (F.col("rest") - F.col("upto") + F.col("within")).alias("left"))
    # the draw inside that range; rows of equal id and size are one
    cut = stored(cut, "cut")
    draws = sized.join(cut, same & (range_ == F.col("cut"))).groupBy("of", "cut", "left", "key", "id", "size").agg(F.count("*").alias("copies"))
    upto = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("of").orderBy("key", "id", "size"))
    ends = draws.withColumn("upto", upto).withColumn("open", F.col("left") - F.col("upto") + F.col("size") * F.col("copies")).where("open >= 0 and left < upto")
    end = ends.groupBy("of").agg(F.min_by(F.struct("key", "id", "size"), "upto").alias("at"), F.min_by(F.floor(F.col("open") / F.col("copies")).cast("long"), "upto").alias("part"))
    told = stored(plan.join(end.withColumnRenamed("of", "at_of"), F.col("of").eqNullSafe(F.col("at_of")), "left").drop("at_of"), "ends")

    here = F.struct("key", "id", "size")
    once = F.when(F.col("at").isNull() | (here > F.col("at")), F.lit(0).cast("long")).when(here < F.col("at"), F.col("size")).otherwise(F.col("part"))
    return sized.join(told, same).select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + once).alias("taken"))


def mixture(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, epoch, text): the mix itself, a row for each time that a document is taken; the document at a cut gives its first words."""
    times = mixed.where("taken > 0").select("id", "source", "size", "taken").distinct()
    rows = docs.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), F.col(text_col).cast("string").alias("text"), n_words(F.col(text_col).cast("string")).alias("z"))
    met = rows.join(times, F.col("i").eqNullSafe(F.col("id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")))
    each = met.select("id", "source", "text", "size", "taken", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), words.cast("int")), " ")
    return each.select("id", "source", "epoch", F.when(words < F.col("size"), cut).otherwise(F.col("text")).alias("text"))
