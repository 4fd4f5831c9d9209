"""Evaluation by task and strategy, pair collation, losses and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.text import wrap_float
from granary.operators import evaluation as E
from granary.plans.common import Query
from granary.plans.metric_queries import _rounded
from granary.sources.tables import load


def _generated(s, d):
    """part as generated texts of four kinds of tasks under two strategies."""
    names = ["bace", "qm9_homo", "retrosynthesis", "chebi-20-mol2text"]
    k = F.col("p_partkey") % 4
    task = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    tagged = lambda tag, x: F.concat(F.lit(f"<{tag}> "), x, F.lit(f" </{tag}>"))
    label = F.when(k == 0, tagged("BOOLEAN", F.when(F.col("p_size") > 25, "True").otherwise("False"))).when(k == 1, wrap_float(F.col("p_size").cast("double"))).when(k == 2, tagged("SMILES", F.col("p_type"))).otherwise(tagged("DESCRIPTION", F.concat_ws(" ", "p_name", "p_type", "p_brand")))
    said = F.when(k == 0, tagged("BOOLEAN", F.when(F.col("p_size") > 20, "True").otherwise("False"))).when(k == 1, wrap_float((F.col("p_size") + F.col("p_partkey") % 3).cast("double"))).when(k == 2, F.concat(F.lit("<SMILES>"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name")))).otherwise(tagged("DESCRIPTION", F.concat_ws(" ", "p_name", "p_brand", "p_type")))
    said = F.when(F.col("p_partkey") % 10 != 9, said).otherwise("nothing")
    return load(s, "part", d).select("p_partkey", task.alias("task"), F.when(F.col("p_size") % 2 == 0, "full").otherwise("semi").alias("strategy"), label.alias("label_text"), said.alias("pred_text"))


def _partials(s, d):
    rows = load(s, "events", d).select(F.col("event_type").alias("task"), (F.col("event_id") % 6).alias("device"), F.when(F.col("event_id") % 5 != 0, F.col("value") - F.col("user_id") % 7).alias("error"))
    tasks = s.createDataFrame([(t,) for t in ("click", "view", "purchase", "no such task")], "task string")
    return _rounded(E.merged(E.partial_sums(rows, ["task", "device"], F.col("error")), tasks), "mae", "rmse", "failure_rate")


def _pairs(s, d):
    arr = lambda x, n: F.transform(F.sequence(F.lit(1), n), lambda i: (i * x).cast("int"))
    k = F.col("l_linenumber")
    return load(s, "lineitem", d).where("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_suppkey", arr(F.lit(3), k).alias("p"), F.when(k != 3, arr(F.lit(5), F.lit(2))).alias("c"), F.when(k == 4, F.array().cast("array<int>")).otherwise(arr(F.lit(7), k)).alias("r"))


def _slots(s, d, part):
    return E.paired_slots(_pairs(s, d), F.col("p"), F.col("c"), F.col("r"), 8, 0, division=3)[part]


PAD = "list_concat({0}, list_transform(range(8 - len({0})), lambda x: 0))"
QUERIES: dict[str, Query] = {
    "evaluate_regression_buckets": (
        lambda s, d: E.evaluate(_generated(s, d)).where("kind = 'regression' and metric in ('n', 'mae', 'failure_rate')").select("task", "strategy", "metric", F.round("value", 6).alias("value")),
        """WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'semi' END AS strategy, CASE WHEN p_partkey % 10 <> 9 THEN CAST(p_partkey % 3 AS DOUBLE) END AS e FROM part WHERE p_partkey % 4 = 1),
        g AS (SELECT strategy, CAST(count(*) AS DOUBLE) AS n, round(avg(e), 6) AS mae, round(count(*) FILTER (e IS NULL) / count(*), 6) AS failure_rate FROM r GROUP BY strategy)
        SELECT 'qm9_homo' AS task, strategy, metric, value FROM (UNPIVOT g ON n, mae, failure_rate INTO NAME metric VALUE value)""",
    ),
    "evaluate_class_buckets": (
        lambda s, d: E.evaluate(_generated(s, d)).where("kind = 'classification' and metric in ('n', 'accuracy', 'recall', 'failure_rate')").select("task", "strategy", "metric", F.round("value", 6).alias("value")),
        """WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'semi' END AS strategy, p_size > 25 AS y, p_size > 20 AS p, p_partkey % 10 <> 9 AS ok FROM part WHERE p_partkey % 4 = 0),
        g AS (SELECT strategy, CAST(count(*) AS DOUBLE) AS n, round(count(*) FILTER (ok AND y = p) / count(*) FILTER (ok), 6) AS accuracy, round(count(*) FILTER (ok AND y AND p) / count(*) FILTER (ok AND y), 6) AS recall, round(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate FROM r GROUP BY strategy)
        SELECT 'bace' AS task, strategy, metric, value FROM (UNPIVOT g ON n, accuracy, recall, failure_rate INTO NAME metric VALUE value)""",
    ),
    "evaluate_molecule_buckets": (
        lambda s, d: E.evaluate(_generated(s, d)).where("kind = 'molecule'").select("task", "strategy", "metric", F.round("value", 6).alias("value")),
        """WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'semi' END AS strategy, replace(p_type, ' ', '') AS a, CASE WHEN p_partkey % 10 <> 9 THEN replace(CASE WHEN p_size > 25 THEN p_type ELSE p_name END, ' ', '') END AS b FROM part WHERE p_partkey % 4 = 2),
        g AS (SELECT strategy, CAST(count(*) AS DOUBLE) AS n, round(1 - count(*) FILTER (b IS NULL) / count(*), 6) AS validity, round(coalesce(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END END), 0), 6) AS exact_match,
        round(coalesce(avg(levenshtein(a, b)), 0), 6) AS levenshtein, round(count(*) FILTER (b IS NULL) / count(*), 6) AS failure_rate FROM r GROUP BY strategy)
        SELECT 'retrosynthesis' AS task, strategy, metric, value FROM (UNPIVOT g ON n, validity, exact_match, levenshtein, failure_rate INTO NAME metric VALUE value)""",
    ),
    "evaluate_caption_buckets": (
        lambda s, d: E.evaluate(_generated(s, d)).where("kind = 'caption' and metric in ('n', 'rouge1', 'failure_rate')").select("task", "strategy", "metric", F.round("value", 6).alias("value")),
        """WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'semi' END AS strategy, p_partkey % 10 <> 9 AS ok FROM part WHERE p_partkey % 4 = 3),
        g AS (SELECT strategy, CAST(count(*) AS DOUBLE) AS n, CASE WHEN count(*) FILTER (ok) > 0 THEN 100.0::DOUBLE ELSE 0 END AS rouge1, round(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate FROM r GROUP BY strategy)
        SELECT 'chebi-20-mol2text' AS task, strategy, metric, value FROM (UNPIVOT g ON n, rouge1, failure_rate INTO NAME metric VALUE value)""",
    ),
    "merged_partials": (
        _partials,
        """WITH e AS (SELECT event_type AS task, CASE WHEN event_id % 5 <> 0 THEN value - user_id % 7 END AS x FROM events)
        SELECT t.task, count(e.task) AS n, round(coalesce(avg(abs(x)), 'nan'::DOUBLE), 6) AS mae, round(coalesce(sqrt(avg(x * x)), 'nan'::DOUBLE), 6) AS rmse, round(CASE WHEN count(e.task) = 0 THEN 'nan'::DOUBLE ELSE 1 - count(x) / count(e.task) END, 6) AS failure_rate
        FROM (VALUES ('click'), ('view'), ('purchase'), ('no such task')) t(task) LEFT JOIN e USING (task) GROUP BY t.task""",
    ),
    "pair_slots": (
        lambda s, d: _slots(s, d, 0).select("l_orderkey", "l_linenumber", "slot", "role", F.array_join("ids", " ").alias("ids"), F.array_join("labels", " ").alias("labels")),
        f"""WITH p AS (SELECT l_orderkey, l_linenumber, list_transform(range(1, l_linenumber + 1), lambda i: CAST(i * 3 AS INTEGER)) AS p, [5, 10] AS c, list_transform(range(1, l_linenumber + 1), lambda i: CAST(i * 7 AS INTEGER)) AS r FROM lineitem WHERE l_quantity > 0 AND l_linenumber NOT IN (3, 4)),
        s AS (SELECT l_orderkey, l_linenumber, p, unnest([{{'slot': 0, 'role': 'sft', 'a': c}}, {{'slot': 1, 'role': 'chosen', 'a': c}}, {{'slot': 2, 'role': 'rejected', 'a': r}}], recursive := true) FROM p),
        w AS (SELECT *, list_slice(list_concat(list_concat(p, a), [0]), 1, 8) AS w FROM s), i AS (SELECT *, {PAD.format('w')} AS i FROM w)
        SELECT l_orderkey, l_linenumber, slot, role, array_to_string(i, ' ') AS ids, array_to_string(list_concat(list_transform(p, lambda x: -100), list_slice(i, len(p) + 1, 8)), ' ') AS labels FROM i""",
    ),
    "pair_outcomes": (
        lambda s, d: _slots(s, d, 1),
        "SELECT CASE l_linenumber WHEN 3 THEN 'no pair' WHEN 4 THEN 'empty answer' ELSE 'kept' END AS outcome, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1",
    ),
    "preference_score": (
        lambda s, d: load(s, "lineitem", d).groupBy("l_linestatus").agg(F.round(F.avg(E.preference_score(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 2, 0.1)), 6).alias("score")),
        "SELECT l_linestatus, round(avg(0.1::DOUBLE * (l_quantity - l_tax) - 0.1::DOUBLE * (l_discount - l_quantity / 2)), 6) AS score FROM lineitem GROUP BY l_linestatus",
    ),
    "total_loss": (
        lambda s, d: load(s, "lineitem", d).groupBy("l_linestatus").agg(F.round(F.avg(E.total_loss(F.when(F.col("l_linenumber") > 2, F.col("l_tax")), F.col("l_discount"), F.col("l_quantity"), anchor_weight=0.5)), 6).alias("loss")),
        "SELECT l_linestatus, round(avg(0.25::DOUBLE * l_discount + 0.5::DOUBLE * l_quantity + CASE WHEN l_linenumber > 2 THEN l_tax ELSE 0 END), 6) AS loss FROM lineitem GROUP BY l_linestatus",
    ),
    "as_of_join": (
        lambda s, d: E.as_of(load(s, "events", d).where("event_type = 'purchase'").select("event_id", "user_id", "ts"), load(s, "events", d).where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), "user_id", "ts", "value").select("event_id", F.col("as_of").alias("viewed")),
        """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT event_id, v.value AS viewed FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    ),
    "coverage_status": (
        lambda s, d: E.coverage(load(s, "documents", d).select("doc_id"), load(s, "labels", d).select("doc_id"), "doc_id"),
        "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(a, 0) AS expected, coalesce(b, 0) AS observed, CASE WHEN coalesce(a, 0) = coalesce(b, 0) THEN 'OK' ELSE 'DIFF' END AS status FROM (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1) d FULL JOIN (SELECT doc_id, count(*) AS b FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id",
    ),
}
