"""Stage audits, reports and validation; and Spark extras on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import audit
from granary.plans.common import TASK_ROWS, Query, task_rows
from granary.sources.tables import load

SPLITS = ["train", "val", "test"]


def _stages(s, d):
    rows = task_rows(s, d)
    return {"raw": rows, "long": rows.where("n_chars >= 400"), "clean": rows.where("n_chars >= 400 and n_chars < 5000")}


STAGES_SQL = f"""WITH {TASK_ROWS} SELECT task, {', '.join(f"count(*) FILTER (split = '{s}' AND {c}) AS {n}_{s}" for n, c in (('raw', 'true'), ('long', 'n_chars >= 400'), ('clean', 'n_chars >= 400 AND n_chars < 5000')) for s in SPLITS)},
count(*) - count(*) FILTER (n_chars >= 400) AS drop_long, count(*) FILTER (n_chars >= 400) - count(*) FILTER (n_chars >= 400 AND n_chars < 5000) AS drop_clean FROM task_rows GROUP BY task"""
BY_SOURCE = "(SELECT source, count(*) AS a, count(*) FILTER (n_chars < 5000) AS b FROM documents GROUP BY source)"


def _by_source(s, d):
    return load(s, "documents", d).groupBy("source").agg(F.count("*").alias("a"), F.count_if(F.expr("n_chars < 5000")).alias("b"))


def _compare(s, d):
    o = load(s, "orders", d).groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.first("v"), 3))


def _unpivot(s, d):
    o = load(s, "lineitem", d).groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return o.unpivot(["l_returnflag"], ["quantity", "discount"], "metric", "value")


def _q1(s, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return load(s, "lineitem", d).where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


def _revenue(s, d):
    n = load(s, "nation", d).join(load(s, "region", d), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(s, "customer", d).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = load(s, "orders", d).join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = load(s, "lineitem", d).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES: dict[str, Query] = {
    "stage_audit_pivot": (lambda s, d: audit.stage_table(_stages(s, d), "task", "split", SPLITS), STAGES_SQL),
    "drop_cause": (
        lambda s, d: _by_source(s, d).select("source", audit.drop_cause(F.col("a"), F.col("b")).alias("cause")),
        f"""SELECT source, CASE WHEN a = 0 THEN 'absent' WHEN a = b THEN 'none' WHEN b = 0 THEN 'all' WHEN b > a THEN 'grown' WHEN abs((a - b)::DOUBLE / a - 0.02) <= 0.01 THEN 'expected' WHEN a - b <= 10 THEN 'few' ELSE 'many' END AS cause FROM {BY_SOURCE}""",
    ),
    "expansion_ratio": (
        lambda s, d: _by_source(s, d).select("source", F.round(audit.expansion(F.col("b"), F.col("a")), 6).alias("ratio")),
        f"SELECT source, round(CASE WHEN b = 0 THEN 'nan'::DOUBLE ELSE a / b END, 6) AS ratio FROM {BY_SOURCE}",
    ),
    "diagnostics_unpivot": (
        lambda s, d: _by_source(s, d).select("source", F.stack(F.lit(2), F.lit("before"), F.col("a"), F.lit("after"), F.col("b")).alias("what", "n")),
        f"SELECT source, 'before' AS what, a AS n FROM {BY_SOURCE} UNION ALL SELECT source, 'after', b FROM {BY_SOURCE}",
    ),
    "validation_report": (
        lambda s, d: audit.validate(load(s, "documents", d), {"long enough": F.col("n_chars") >= 100, "length agrees": F.col("n_chars") == F.length("text"), "known language": F.col("lang").isin("en", "fr"), "ends with a stop": F.col("text").endswith(".")}, "doc_id"),
        """WITH e AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars >= 100 THEN NULL ELSE 'long enough' END, CASE WHEN n_chars = length(text) THEN NULL ELSE 'length agrees' END,
          CASE WHEN lang IN ('en', 'fr') THEN NULL ELSE 'known language' END, CASE WHEN ends_with(text, '.') THEN NULL ELSE 'ends with a stop' END], lambda x: x IS NOT NULL)) AS category FROM documents)
        SELECT c.category, coalesce(n, 0) AS errors, coalesce(x, '') AS examples FROM (VALUES ('long enough'), ('length agrees'), ('known language'), ('ends with a stop')) c(category)
        LEFT JOIN (SELECT category, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:10], ',') AS x FROM e GROUP BY category) e ON e.category = c.category""",
    ),
    "group_totals_overall": (
        lambda s, d: audit.group_totals(load(s, "documents", d), "lang", "source"),
        "SELECT lang, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ' + ') AS sources FROM documents GROUP BY lang UNION ALL SELECT 'Overall', count(*), '' FROM documents",
    ),
    "count_by_task": (lambda s, d: load(s, "documents", d).groupBy("lang").agg(F.count("*").alias("n")), "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "conditional_counts": (
        lambda s, d: load(s, "pages", d).agg(F.count_if(F.contains("url", F.lit("/en/"))).alias("en"), F.count_if(F.contains("url", F.lit("?"))).alias("query")),
        "SELECT count(*) FILTER (contains(url, '/en/')) AS en, count(*) FILTER (contains(url, '?')) AS query FROM pages",
    ),
    "reason_breakdown": (
        lambda s, d: load(s, "events", d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type"),
        "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    ),
    "comparison_pivot": (
        _compare,
        "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 3) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 3) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 3) AS P FROM orders GROUP BY o_orderpriority",
    ),
    "metric_unpivot": (
        _unpivot,
        "SELECT l_returnflag, 'quantity' AS metric, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'discount', round(avg(l_discount), 6) FROM lineitem GROUP BY 1",
    ),
    "metric_rescale": (
        lambda s, d: load(s, "customer", d).where(~F.col("c_mktsegment").isin("BUILDING")).select("c_custkey", F.when(F.col("c_nationkey") < 10, F.col("c_acctbal") / 100).otherwise(F.col("c_acctbal")).alias("v"), (F.col("c_acctbal") - F.nullif(F.col("c_nationkey"), F.lit(3))).alias("delta")),
        "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_acctbal / 100 ELSE c_acctbal END AS v, c_acctbal - nullif(c_nationkey, 3) AS delta FROM customer WHERE c_mktsegment NOT IN ('BUILDING')",
    ),
    "null_row_separation": (
        lambda s, d: load(s, "documents", d).join(load(s, "labels", d).withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"), "left").groupBy(F.col("quality").isNull().alias("unlabelled")).agg(F.count("*").alias("n")),
        "SELECT quality IS NULL AS unlabelled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "extra_pricing_summary": (
        _q1,
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    ),
    "extra_region_revenue": (
        _revenue,
        "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "extra_event_windows": (
        lambda s, d: load(s, "events", d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"),
        "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    ),
}
