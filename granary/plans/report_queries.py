"""Reports, routing and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import checks, text
from granary.operators import audit, evaluation, metrics, reports, training
from granary.plans.common import SCORED, TASK_ROWS, Query, scored, scratch, task_rows
from granary.plans.evaluation_queries import _generated, _pairs
from granary.sources import sinks, tables
from granary.sources.tables import load


def _routed(s, d):
    tables.route("bace", "labels", lambda df: df.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    tables.route("chebi-20-mol2text", "documents", lambda df: df.where("n_chars > 500").select(F.col("doc_id").alias("id")))
    return tables.load_tasks(s, d, ["bace", "chebi-20-mol2text"]).groupBy("task").agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.sum("id").alias("ids"))


def _legacy(s, d):
    at = scratch(s)
    load(s, "documents", d).select("doc_id").write.parquet(f"{at}/SELFIES/root/train")
    return s.read.parquet(tables.first_existing(s, f"{at}/root/train", f"{at}/SELFIES/root/train")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def _lookup(s, d):
    """part types as datasets whose values were logged under one of four layouts, some as text, some not at all."""
    p = load(s, "part", d)
    dataset, k = F.concat(F.lit("d"), "p_partkey"), F.col("p_partkey") % 6
    key = (
        F.when(k == 0, F.concat(F.lit("val/"), dataset, F.lit("/low_confidence_random/mae"))).when(k == 1, F.concat(F.lit("val/mae/"), dataset, F.lit("/low_confidence_random")))
        .when(k == 2, F.concat(F.lit("val/"), dataset, F.lit("/random_random/mae"))).when(k == 3, F.concat(F.lit("val/mae/"), dataset, F.lit("/random_random"))).otherwise(F.concat(F.lit("val/"), dataset, F.lit("/other/mae")))
    )
    text_ = F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    summary = p.select(key.alias("key"), text_.alias("value")).unionByName(p.select(F.concat(F.lit("val/mae/"), dataset, F.lit("/random_random")).alias("key"), F.lit("-1").alias("value")).where(k == 0))
    wanted = p.select(dataset.alias("dataset"), F.lit("mae").alias("metric"), F.lit("random").alias("strategy"))
    return reports.lookup(wanted, summary).select("dataset", "value", F.col("key").isNotNull().alias("found"))


def _slices(s, d):
    rows = load(s, "lineitem", d).select((F.col("l_orderkey") % 50).alias("batch"), F.when(F.col("l_linenumber") < 6, F.col("l_returnflag")).alias("task"), "l_discount", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("l_tax"))
    return reports.slice_means(rows, "batch", "task", ["l_discount", "l_tax"]).select("batch", "task", "n", F.round("l_discount", 6).alias("discount"), F.round("l_tax", 6).alias("tax"))


def _audit_csv(s, d):
    at, rows = scratch(s), task_rows(s, d)
    told = audit.stage_table({"raw": rows, "kept": rows.where("n_chars > 500")}, "task", "split", ["train", "val", "test"])
    sinks.write_csv(told, at, "task")
    return s.read.schema(told.schema).csv(at, header=True).select("task", "raw_train", "kept_train", "drop_kept")


def _shown(s, d):
    return reports.shown(evaluation.evaluate(_generated(s, d)), "regression").select("task", "strategy", F.round("mae", 6).alias("mae"), F.round("failure_rate", 6).alias("failure_rate"))


def _within(s, d):
    kept, told = reports.within(load(s, "documents", d), F.size(F.split("text", " ")), 100)
    one = F.lit(1).alias("one")  # a row on both sides
    return told.select(one, "n", "kept", F.round("percent", 6).alias("percent")).join(kept.agg(F.sum("doc_id").alias("ids")).select(one, "ids"), "one").drop("one")


def _fallbacks(s, d):
    words = F.split("p_name", " ")
    swapped = F.when(F.col("p_partkey") % 3 == 0, F.array_join(F.concat(F.slice(words, 1, 1), F.array(F.lit("x"))), " ")).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    told = checks.fallback_payload(F.col("p_name"), swapped, F.col("p_size"), 0.3, F.lit("no_substructure"))
    return load(s, "part", d).select(told.alias("f")).groupBy("f.reason").agg(F.count("*").alias("n"), F.sum("f.active").alias("active"), F.count_if(F.col("f.modified") == "CCC").alias("fixed"), F.round(F.sum("f.wanted"), 4).alias("wanted"))


def _forms(s, d):
    k = F.col("p_partkey") % 8
    made = (
        F.when(k == 0, "[C][O]").when(k == 1, "[C][O").when(k == 2, "[C].[N]>>[O]").when(k == 3, "CC(=O)O").when(k == 4, "C1CC(").when(k == 5, "C1CCCCC1>>CCO.N").when(k == 6, "<None>")
    )
    return load(s, "part", d).select(k.alias("kind"), checks.selfies_form(made).alias("selfies"), checks.smiles_form(made).alias("smiles")).groupBy("kind", "selfies", "smiles").agg(F.count("*").alias("n"))


def _older(s, d):
    p = F.when(F.col("n_chars") % 9 == 0, F.lit(-1.0)).otherwise(F.col("p"))
    return metrics.classification(scored(s, d), ["task"], F.when(p != -1, F.col("y")), 1 - p, p).select("task", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "failure_rate")])


def _anchored(s, d):
    rows = load(s, "events", d).select("event_id", "event_type", F.floor(F.col("event_id") / 32).alias("batch"), F.sqrt(F.abs("value")).alias("value"), (F.col("user_id") % 7).alias("a"), (F.col("event_id") % 11).alias("b"), (F.col("user_id") % 3).alias("c"))
    told = training.anchored_preferences(rows, "event_type", "batch", "event_id", ("value", "a", "b", "c"), alpha=0.9, clip=1.0)
    return told.select("event_id", *[F.round(c, 6).alias(c) for c in ("average", "margin", "gamma", "loss", "anchor")])


def _batches(s, d):
    _, counts = evaluation.paired_slots(_pairs(s, d), F.col("p"), F.col("c"), F.col("r"), 8, 0, by="l_suppkey")
    return evaluation.check_pairs(counts, "l_suppkey")


QUERIES: dict[str, Query] = {
    "routed_sources": (
        _routed,
        "SELECT 'bace' AS task, count(*) AS n, count(toxic) AS labels, CAST(sum(doc_id) AS BIGINT) AS ids FROM labels UNION ALL SELECT 'chebi-20-mol2text', count(*), 0, CAST(sum(doc_id) AS BIGINT) FROM documents WHERE n_chars > 500",
    ),
    "legacy_path": (_legacy, "SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents"),
    "toy_per_split": (
        lambda s, d: reports.toy_splits(task_rows(s, d).select("doc_id", "split"), "split", "doc_id", 7),
        f"WITH {TASK_ROWS} SELECT doc_id, split FROM task_rows QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 7",
    ),
    "metric_lookup": (
        _lookup,
        "SELECT 'd' || p_partkey AS dataset, CASE WHEN p_partkey % 6 < 4 AND p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 6 = 0 THEN -1.0 END AS value, p_partkey % 6 = 0 OR (p_partkey % 6 < 4 AND p_size % 5 <> 0) AS found FROM part",
    ),
    "slice_means": (
        _slices,
        """WITH r AS (SELECT l_orderkey % 50 AS batch, CASE WHEN l_linenumber < 6 THEN l_returnflag END AS task, l_discount AS x, CASE WHEN l_tax > 0.02 THEN l_tax END AS y FROM lineitem)
        SELECT batch, task, count(*) AS n, round(avg(x), 6) AS discount, round(avg(y), 6) AS tax FROM r WHERE task IS NOT NULL GROUP BY ALL UNION ALL SELECT batch, NULL, count(*), round(avg(x), 6), round(avg(y), 6) FROM r GROUP BY batch""",
    ),
    "audit_export": (
        _audit_csv,
        f"WITH {TASK_ROWS} SELECT task, count(*) FILTER (split = 'train') AS raw_train, count(*) FILTER (split = 'train' AND n_chars > 500) AS kept_train, count(*) FILTER (n_chars <= 500) AS drop_kept FROM task_rows GROUP BY task",
    ),
    "shown_by_kind": (
        _shown,
        """SELECT 'qm9_homo' AS task, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'semi' END AS strategy, round(avg(CASE WHEN p_partkey % 10 <> 9 THEN CAST(p_partkey % 3 AS DOUBLE) END), 6) AS mae, round(count(*) FILTER (p_partkey % 10 = 9) / count(*), 6) AS failure_rate
        FROM part WHERE p_partkey % 4 = 1 GROUP BY 2""",
    ),
    "length_filter": (
        _within,
        "SELECT count(*) AS n, count(*) FILTER (z <= 100) AS kept, round(100 * count(*) FILTER (z <= 100) / count(*), 6) AS percent, CAST(sum(doc_id) FILTER (z <= 100) AS BIGINT) AS ids FROM (SELECT doc_id, len(string_split(text, ' ')) AS z FROM documents)",
    ),
    "distinct_tasks": (
        lambda s, d: task_rows(s, d).groupBy("split").agg(F.count_distinct("task").alias("tasks")),
        f"WITH {TASK_ROWS} SELECT split, count(DISTINCT task) AS tasks FROM task_rows GROUP BY split",
    ),
    "fallback_payloads": (
        _fallbacks,
        """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'atom_swap_fallback' ELSE 'no_substructure' END AS reason, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END) AS BIGINT) AS active, count(*) FILTER (p_partkey % 3 > 0) AS fixed, round(sum(0.3::DOUBLE), 4) AS wanted
        FROM part GROUP BY 1""",
    ),
    "molecule_forms": (_forms, "SELECT p_partkey % 8 AS kind, p_partkey % 8 IN (0, 2) AS selfies, p_partkey % 8 NOT IN (1, 4) AS smiles, count(*) AS n FROM part GROUP BY ALL"),
    "bare_tags": (
        lambda s, d: load(s, "part", d).select("p_partkey", checks.bare(F.concat(F.lit("<SELFIES> "), "p_name", F.lit(" </SELFIES>")), "SELFIES").alias("trimmed"), checks.bare(F.concat(F.lit("<SELFIES> "), "p_name", F.lit(" </SELFIES>")), "SELFIES", False).alias("joined")),
        "SELECT p_partkey, trim(p_name) AS trimmed, replace(p_name, ' ', '') AS joined FROM part",
    ),
    "finite_values": (
        lambda s, d: load(s, "events", d).select("event_id", text.finite(F.when(F.col("event_id") % 3 == 0, float("inf")).when(F.col("event_id") % 3 == 1, float("-inf")).otherwise(F.col("value"))).alias("value")),
        "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'nan'::DOUBLE ELSE value END AS value FROM events",
    ),
    "cls_metrics_failure_marks": (
        _older,
        f"""WITH {SCORED}, b AS (SELECT task, y, CASE WHEN p > 1 - p THEN 1 ELSE 0 END AS pr, n_chars % 9 <> 0 AS ok FROM scored)
        SELECT task, count(*) AS n, round(CASE WHEN count(*) FILTER (ok) = 0 THEN 'nan'::DOUBLE ELSE count(*) FILTER (ok AND y = pr) / count(*) FILTER (ok) END, 6) AS accuracy,
        round(CASE WHEN count(*) FILTER (ok) = 0 THEN 'nan'::DOUBLE ELSE coalesce(count(*) FILTER (ok AND y = 1 AND pr = 1) / nullif(count(*) FILTER (ok AND y = 1), 0), 0) END, 6) AS recall, round(1 - count(*) FILTER (ok) / count(*), 6) AS failure_rate FROM b GROUP BY task""",
    ),
    "preference_anchored": (
        _anchored,
        """WITH e AS (SELECT event_id, event_type, event_id // 32 AS batch, 0.1::DOUBLE * (sqrt(abs(value)) - user_id % 7) AS w, 0.1::DOUBLE * (event_id % 11 - user_id % 3) AS l, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
        z AS (SELECT event_type, batch, max(k) AS k FROM e GROUP BY ALL), a AS (SELECT z.event_type, z.batch, sum(CASE WHEN e.k = 1 THEN 1.0 ELSE 0.1 END * pow(0.9::DOUBLE, z.k - e.k) * e.w) AS average FROM z JOIN e ON e.event_type = z.event_type AND e.k <= z.k GROUP BY ALL),
        m AS (SELECT e.*, average, greatest(-abs(w), least(abs(w), w - l)) AS margin, 0.5::DOUBLE * abs(average) AS gamma FROM e JOIN a USING (event_type, batch)), x AS (SELECT *, gamma - margin AS u, l - 1.5::DOUBLE * average AS v FROM m)
        SELECT event_id, round(average, 6) AS average, round(margin, 6) AS margin, round(gamma, 6) AS gamma, round(greatest(u, 0.0) + ln(1 + exp(-abs(u))), 6) AS loss, round(greatest(v, 0.0) + ln(1 + exp(-abs(v))), 6) AS anchor FROM x""",
    ),
    "pair_batches": (
        _batches,
        "SELECT l_suppkey, count(*) FILTER (l_linenumber NOT IN (3, 4)) AS kept, count(*) FILTER (l_linenumber IN (3, 4)) AS left_out FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey",
    ),
    "sampling_steps": (
        lambda s, d: load(s, "lineitem", d).select("l_orderkey", "l_linenumber", evaluation.steps_per_block(F.col("l_partkey") % 100 + 1, F.col("l_suppkey") % 40 + 1, F.col("l_linenumber") * 4).alias("steps")),
        """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 100 + 1) // (l_suppkey % 40 + 1) AS b, l_linenumber * 4 AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN b > 0 AND s % nullif(b, 0) = 0 THEN CAST(s // nullif(b, 0) AS INTEGER) END AS steps FROM b""",
    ),
}
