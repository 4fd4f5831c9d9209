"""Training-side arithmetic and graph dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import graphs, training
from granary.plans.common import Query
from granary.sources.tables import load


def _tokens(s, d):
    """line items as answer tokens: row = order, nll = discount + tax, p from the line number."""
    li = load(s, "lineitem", d)
    return li.select("l_returnflag", F.col("l_orderkey").alias("row"), (F.col("l_discount") + F.col("l_tax")).alias("nll"), ((F.col("l_linenumber") % 5 + 1) / 5).alias("p"), F.lit(8).alias("len"), (F.col("l_linenumber") % 2).alias("draw"))


TOKENS = "(SELECT l_returnflag, l_orderkey AS row, l_discount + l_tax AS nll, (l_linenumber % 5 + 1) / 5 AS p, 8 AS len, l_linenumber % 2 AS draw FROM lineitem)"


def _collated(s, d):
    x = load(s, "part", d).select("p_partkey", training.collate(F.array(F.col("p_size"), F.lit(7)), F.sequence(F.lit(1), F.col("p_size") % 6 + 1), 2, 0, 8).alias("c"))
    return x.select("p_partkey", F.array_join("c.input_ids", ",").alias("ids"), F.array_join("c.labels", ",").alias("labels"), "c.length")


def _padded(s, d):
    x = load(s, "part", d).select("p_partkey", "p_brand", F.sequence(F.lit(1), F.col("p_size") % 9 + 1).alias("ids"))
    return training.left_pad(x, "p_brand", "ids", 0).select("p_partkey", F.array_join("ids", ",").alias("ids"))


def _graph(s, d):
    edges = load(s, "lineitem", d).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("src <> dst").distinct()
    nodes = load(s, "part", d).select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("value"))
    return training.message_pass(edges, nodes)


def _masked(s, d):
    x = training.mask_tokens(load(s, "lineitem", d).select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", F.lit(0.3))
    return x.select("l_orderkey", "l_linenumber", "masked")



def _preference_loss(s, d):
    w, r = F.col("l_extendedprice") / 10000, F.col("l_quantity") / 10
    loss = lambda hinge: F.round(F.avg(training.preference_loss(w, r, F.lit(0.1), 3.0, hinge)), 6)
    return load(s, "lineitem", d).groupBy("l_linestatus").agg(loss(False).alias("logistic"), loss(True).alias("hinge"))


QUERIES: dict[str, Query] = {
    "masked_loss": (
        lambda s, d: training.masked_loss(_tokens(s, d), ["l_returnflag"], "nll", "p", "len").withColumn("loss", F.round("loss", 6)),
        f"SELECT l_returnflag, round(avg(loss), 6) AS loss, count(*) AS n FROM (SELECT l_returnflag, row, sum(nll / p) / 8 AS loss FROM {TOKENS} GROUP BY ALL) GROUP BY l_returnflag",
    ),
    "elbo_mean": (
        lambda s, d: training.elbo(_tokens(s, d), "row", "draw", "nll", "p", "len").withColumn("elbo", F.round("elbo", 9)),
        f"SELECT row, round(avg(e), 9) AS elbo FROM (SELECT row, draw, -sum(nll / p) / 8 AS e FROM {TOKENS} GROUP BY ALL) GROUP BY row",
    ),
    "preference_loss": (
        _preference_loss,
        "SELECT l_linestatus, round(avg(greatest(-m, 0.0) + ln(1 + exp(-abs(m)))), 6) AS logistic, round(avg(greatest(0.0, -m)), 6) AS hinge FROM (SELECT l_linestatus, greatest(-3.0, least(3.0, l_extendedprice / 10000 - l_quantity / 10)) - 0.1::DOUBLE AS m FROM lineitem) GROUP BY l_linestatus",
    ),
    "pair_softmax": (
        lambda s, d: load(s, "customer", d).select("c_custkey", F.round(training.pair_softmax(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), F.lit(4), F.lit(5)), 6).alias("p")),
        "SELECT c_custkey, round(1 / (1 + exp(c_acctbal / 1000 / 4 - c_nationkey::DOUBLE / 5)), 6) AS p FROM customer",
    ),
    "mask_ratio_buckets": (
        lambda s, d: load(s, "lineitem", d).groupBy(training.mask_bucket(F.col("l_quantity") / 50).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean")),
        "SELECT CASE WHEN x <= 0.2 THEN 0 WHEN x <= 0.4 THEN 1 WHEN x <= 0.6 THEN 2 WHEN x <= 0.8 THEN 3 ELSE 4 END AS bucket, count(*) AS n, round(avg(l_discount), 6) AS mean FROM (SELECT l_quantity / 50 AS x, l_discount FROM lineitem) GROUP BY 1",
    ),
    "learning_rate": (
        lambda s, d: load(s, "events", d).select("event_id", F.round(training.learning_rate(F.col("event_id"), 1.0, 0.1, 100, 200, 300), 9).alias("lr")),
        "SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100 WHEN event_id < 300 THEN 1.0 WHEN event_id < 600 THEN 1.0 - 0.9 * (event_id - 300) / 300 ELSE 0.1 END::DOUBLE, 9) AS lr FROM events",
    ),
    "sft_collate": (
        _collated,
        """SELECT p_partkey, array_to_string(x[1:8] || list_transform(range(8 - len(x[1:8])), lambda i: 0), ',') AS ids, array_to_string(y[1:8] || list_transform(range(8 - len(y[1:8])), lambda i: -100), ',') AS labels, CAST(len(x[1:8]) AS INTEGER) AS length
        FROM (SELECT p_partkey, [p_size, 7] || range(1, p_size % 6 + 2) || [2] AS x, [-100, -100] || range(1, p_size % 6 + 2) || [2] AS y FROM part)""",
    ),
    "left_pad_batch": (
        _padded,
        """SELECT p_partkey, array_to_string(list_transform(range(m - k), lambda i: 0) || range(1, k + 1), ',') AS ids FROM (SELECT p_partkey, p_size % 9 + 1 AS k, max(p_size % 9 + 1) OVER (PARTITION BY p_brand) AS m FROM part)""",
    ),
    "mask_tokens": (
        _masked,
        """SELECT l_orderkey, l_linenumber, hit OR (NOT bool_or(hit) OVER (PARTITION BY l_orderkey) AND row_number() OVER (PARTITION BY l_orderkey ORDER BY u, l_linenumber) = 1) AS masked
        FROM (SELECT *, u < 0.3 AS hit FROM (SELECT l_orderkey, l_linenumber, CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM lineitem))""",
    ),
    "message_passing": (
        _graph,
        """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey UNION ALL SELECT p_partkey, p_partkey FROM part)
        SELECT dst AS node, sum(p_size::DOUBLE) AS value FROM e JOIN part ON src = p_partkey GROUP BY dst""",
    ),
    "mean_pool": (
        lambda s, d: graphs.mean_pool(load(s, "embeddings", d).select("label", F.posexplode("embedding").alias("k", "x")), ["label", "k"], "x").select("label", "k", F.round("pooled", 5).alias("mean")),
        "SELECT label, k, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS k, unnest(embedding) AS x FROM embeddings) GROUP BY label, k",
    ),
    "variant_rotation": (
        lambda s, d: load(s, "documents", d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("epoch")).select("doc_id", "epoch", F.element_at(F.array(*[F.lit(f"v{i}") for i in range(6)]), F.pmod(F.col("epoch") + F.col("doc_id"), F.lit(6)).cast("int") + 1).alias("variant")),
        "SELECT doc_id, CAST(e AS INTEGER) AS epoch, 'v' || ((e + doc_id) % 6) AS variant FROM documents, range(4) r(e)",
    ),
    "trial_interleave": (
        lambda s, d: load(s, "events", d).groupBy(F.pmod("event_id", F.lit(6)).alias("rank")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")),
        "SELECT event_id % 6 AS rank, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
    ),
}
