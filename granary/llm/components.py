"""Connected components by alternating large-star and small-star passes; nothing is gathered on the driver but three numbers a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, stored


#: Links of a node up to which a task may hold them all (24 bytes each); with more, nodes are joined so that their links can be split.
HUB = 1 << 17


def _stars(links: DataFrame) -> DataFrame:
    """(u, v, n): both passes by windows, a shuffle each; a row gives a row, so rows repeat. n: links of the nodes that it passed."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    of = Window.partitionBy("u")
    large = both.select("u", "v", F.least(F.min("v").over(of), "u").alias("m"), F.count("*").over(of).alias("n"))
    down = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), "n")
    small = down.select("u", "v", F.min("v").over(of).alias("m"), F.greatest("n", F.count("*").over(of)).alias("n"))
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), "n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored before the join, so that the rows of a hub can be split over tasks
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links between longs -> (node, component): the smallest node that links reach, for every node with a link.

    Loops and null ends are ignored; an empty input gives an empty result. A pass sends each link to its nodes and takes minima. From
    ``HUB`` links of a node on, minima are taken with map-side combine and joined back, so a hub is an ordinary skewed join that
    adaptive execution splits.
    """
    links = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    ends = links.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    most = ends.agg(F.max("n")).first()[0]
    seen = None
    for _ in range(max_rounds) if most else ():
        crowded = most > HUB
        told = Observation()
        passed = _small_star(_large_star(links)).withColumn("n", F.lit(most)) if crowded else _stars(links)
        rows, total = F.count("*").alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
        before, links = links, stored(passed.observe(told, rows, total, F.max("n").alias("most")).select("u", "v"), "links")
        discard(before)
        now, most = (crowded, told.get["rows"], told.get["total"]), max(most, told.get["most"])
        if now == seen:
            break
        seen = now
    else:
        if most:
            raise RuntimeError(f"links did not settle in {max_rounds} passes")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
