"""Graphs as tables: messages over edges with features, induced subgraphs, dense batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def messages(edges: DataFrame, nodes: DataFrame, how: str = "gin", eps: float = 0.0, slope: float = 0.2) -> DataFrame:
    """(node, value): one round over (src, dst, edge) edges and (node, value) nodes; nodes without edges keep their own part.

    ``gin`` is (1 + eps) x plus the sum of the positive parts of neighbour and edge, ``sage`` x plus their mean, and ``gcn`` the sum over
    neighbours and the node itself, each divided by the root of both ends' degrees (loops counted, their edge being 0). ``gat`` is the
    mean of these messages (the node's own is x) with weights by a softmax over each node's edges of the leaky (``slope`` below 0) sum of
    the message and the node's own value.
    """
    if how not in ("gin", "sage", "gcn", "gat"):
        raise ValueError(f"unknown messages: {how}")
    known = nodes.select("node", F.col("value").alias("x"))
    sent = edges.join(known, edges.src == known.node).select("src", "dst", (F.col("x") + F.col("edge")).alias("m"))
    if how == "gcn":
        degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("d"))
        sized = known.join(degree, "node", "left").select("node", "x", (F.coalesce("d", F.lit(0)) + 1).alias("d"))
        ends = sent.join(sized.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(sized.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
        got = ends.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("m") / F.sqrt(F.col("ds") * F.col("dd"))).alias("m"))
        return sized.join(got, "node", "left").select("node", (F.col("x") / F.col("d") + F.coalesce("m", F.lit(0.0))).alias("value"))
    if how == "gat":
        own = known.select(F.col("node").alias("dst"), F.col("x").alias("own"))
        asked = sent.select("dst", "m").unionByName(known.select(F.col("node").alias("dst"), F.col("x").alias("m"))).join(own, "dst")
        score = F.col("m") + F.col("own")
        scored = asked.select("dst", "m", F.when(score < 0, slope * score).otherwise(score).alias("s"))
        highest = scored.groupBy(F.col("dst").alias("node")).agg(F.max("s").alias("top"))  # so that no exponent overflows
        weight = F.exp(F.col("s") - F.col("top"))
        return scored.join(highest, F.col("dst") == F.col("node")).groupBy("node").agg((F.sum(weight * F.col("m")) / F.sum(weight)).alias("value"))
    total = F.sum(F.greatest("m", F.lit(0.0))) if how == "gin" else F.avg("m")
    got = sent.groupBy(F.col("dst").alias("node")).agg(total.alias("m"))
    return known.join(got, "node", "left").select("node", ((1 + eps if how == "gin" else 1) * F.col("x") + F.coalesce("m", F.lit(0.0))).alias("value"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``kept`` (node)."""
    one = kept.select(F.col("node").alias("src")).distinct()
    return edges.join(one, "src", "left_semi").join(one.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*edges.columns)


def dense_batch(nodes: DataFrame, graph: str, order: str, value: str, pad: Column) -> DataFrame:
    """(graph, values, mask): each graph's values in order, padded to the largest graph, and which places are real."""
    told = nodes.groupBy(graph).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))
    widest = told.agg(F.max(F.size("values")).alias("_w"))  # one row
    sized = told.join(F.broadcast(widest.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")
    fill = F.col("_w") - F.size("values")
    return sized.select(graph, F.concat("values", F.array_repeat(pad, fill)).alias("values"), F.concat(F.transform("values", lambda _: F.lit(True)), F.array_repeat(F.lit(False), fill)).alias("mask"))


def mean_pool(nodes: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, pooled): means over the nodes of each graph, or of each component of a graph's vectors."""
    return nodes.groupBy(*by).agg(F.avg(value).alias("pooled"))
