"""Sources, decontamination, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.taxonomy import task_dimension, task_kind
from granary.functions.text import component_key
from granary.operators import decontam, history, sampling
from granary.plans.common import TASK_ROWS, Query, task_rows
from granary.plans.evaluation_queries import _generated
from granary.sources.shared import stored
from granary.sources.tables import folder_names, load, metadata_split, require, toy_sample

FAMILY = {"en": "north", "de": "north", "fr": "south", "es": "south"}
LOSERS = ["de", "es"]


def _family(task):
    return F.when(task.isin("en", "de"), "north").when(task.isin("fr", "es"), "south")


def _leaked(spark, sf):
    return decontam.flag_leakage(_rows(spark, sf), "task")


def _flagged(spark, sf):
    rows = _leaked(spark, sf)
    kept = rows.where(~F.col("leaked")).drop("leaked")
    return decontam.flag_family_duplicates(kept, _family(F.col("task")), F.col("task").isin(LOSERS))


def _union(spark, sf):
    d = load(spark, "documents", sf)
    train, rest = d.where("doc_id % 2 = 0").select("doc_id", "lang"), d.where("doc_id % 2 = 1").select("lang", "doc_id")
    return train.unionByName(rest).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


def _require(spark, sf):
    """The tables of the folder as rows; fails if one that is configured isn't there."""
    found = folder_names(spark, sf, r"^(.+)\.parquet$", ["name"])
    require([r["name"] for r in found.collect()], WANTED)
    return found.where(F.col("name").isin(WANTED))


def _contained(spark, sf):
    items, docs = load(spark, "benchmark", sf), load(spark, "documents", sf)
    return decontam.containment(docs.select(F.col("doc_id").alias("id"), "text"), items.select("item_id", "text")).select("item_id", "n_docs")


def _rows(spark, sf):
    """Task rows without their texts, which are read and hashed once."""
    return stored(task_rows(spark, sf).drop("text"))


WANTED = ["documents", "events", "labels"]
LEAKED = f"""{TASK_ROWS}, eval_keys AS (SELECT DISTINCT task, key FROM task_rows WHERE split IN ('test', 'val') AND key IS NOT NULL),
leaked AS (SELECT t.*, t.split = 'train' AND e.key IS NOT NULL AS leaked FROM task_rows t LEFT JOIN eval_keys e ON t.task = e.task AND t.key = e.key)"""
FLAGGED = f"""{LEAKED}, kept AS (SELECT *, CASE WHEN task IN ('en', 'de') THEN 'north' WHEN task IN ('fr', 'es') THEN 'south' END AS family FROM leaked WHERE NOT leaked),
anchors AS (SELECT DISTINCT family, key FROM kept WHERE split = 'train' AND key IS NOT NULL AND family IS NOT NULL AND task NOT IN ('de', 'es')),
flagged AS (SELECT k.*, k.split = 'train' AND k.task IN ('de', 'es') AND a.key IS NOT NULL AS duplicated FROM kept k LEFT JOIN anchors a ON k.family = a.family AND k.key = a.key)"""

QUERIES: dict[str, Query] = {
    "scan_filter_equal": (
        lambda s, d: load(s, "documents", d).where("lang = 'fr'").groupBy("source").agg(F.count("*").alias("n")),
        "SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY source",
    ),
    "scan_in_list": (
        lambda s, d: load(s, "events", d).where(F.col("event_type").isin("click", "view", "purchase")).groupBy("event_type").agg(F.count("*").alias("n")),
        "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type",
    ),
    "scan_metadata_split": (
        lambda s, d: load(s, "pages", d).select(F.explode(metadata_split(F.concat_ws(" ", F.when(F.col("page_id") % 3 < 2, "train"), F.when(F.col("page_id") % 3 > 0, "test")))).alias("split")).groupBy("split").agg(F.count("*").alias("n")),
        "SELECT split, count(*) AS n FROM (SELECT unnest(CASE page_id % 3 WHEN 0 THEN ['train'] WHEN 1 THEN ['train', 'test'] ELSE ['test'] END) AS split FROM pages) GROUP BY split",
    ),
    "scan_hashed_split": (
        lambda s, d: task_rows(s, d).groupBy("task", "split").agg(F.count("*").alias("n")),
        f"WITH {TASK_ROWS} SELECT task, split, count(*) AS n FROM task_rows GROUP BY task, split",
    ),
    "scan_toy_sample": (
        lambda s, d: toy_sample(load(s, "documents", d), 25, "doc_id").select("doc_id", "lang"),
        "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25",
    ),
    "scan_existence_contract": (_require, "SELECT * FROM (VALUES ('documents'), ('events'), ('labels')) t(name)"),
    "task_taxonomy": (
        lambda s, d: _generated(s, d).withColumn("again", task_kind(F.col("task"))).join(task_dimension(s), "task").groupBy("kind", "again").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks")),
        "SELECT k AS kind, k AS again, count(*) AS n, CAST(1 AS BIGINT) AS tasks FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'classification' WHEN 1 THEN 'regression' WHEN 2 THEN 'molecule' ELSE 'caption' END AS k FROM part) GROUP BY k",
    ),
    "decontam_eval_keys": (
        lambda s, d: decontam.eval_keys(task_rows(s, d), "task").groupBy("task").agg(F.count("*").alias("n_keys")),
        f"WITH {LEAKED} SELECT task, count(*) AS n_keys FROM eval_keys GROUP BY task",
    ),
    "decontam_left_anti": (
        lambda s, d: decontam.remove_leakage(_rows(s, d), "task").select("doc_id", "task"),
        f"WITH {LEAKED} SELECT doc_id, task FROM leaked WHERE split = 'train' AND NOT leaked",
    ),
    "decontam_before_after": (
        lambda s, d: decontam.before_after(_leaked(s, d), F.col("leaked")),
        f"""WITH {LEAKED}, c AS (SELECT task, split, count(*) AS before, count(*) FILTER (NOT leaked) AS after FROM leaked GROUP BY task, split)
        SELECT *, before - after AS removed FROM c UNION ALL SELECT 'TOTAL', 'all', CAST(sum(before) AS BIGINT), CAST(sum(after) AS BIGINT), CAST(sum(before) - sum(after) AS BIGINT) FROM c""",
    ),
    "decontam_containment": (
        _contained,
        """WITH b AS (SELECT item_id, w, least(len(w), 8) AS k FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
        a AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
        d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), (SELECT DISTINCT k FROM b) WHERE len(w) >= k))
        SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM d JOIN a USING (k, g) GROUP BY item_id""",
    ),
    "family_dedup": (
        lambda s, d: _flagged(s, d).where("split = 'train'").groupBy("task").agg(F.count_if(~F.col("duplicated")).alias("kept"), F.count_if("duplicated").alias("removed")),
        f"WITH {FLAGGED} SELECT task, count(*) FILTER (NOT duplicated) AS kept, count(*) FILTER (duplicated) AS removed FROM flagged WHERE split = 'train' GROUP BY task",
    ),
    "removal_rollup": (
        lambda s, d: decontam.removals(_leaked(s, d), F.when(F.col("leaked"), "eval_blacklist")),
        f"WITH {LEAKED} SELECT task, split, reason, count(*) AS removed FROM (SELECT task, split, 'eval_blacklist' AS reason FROM leaked WHERE leaked) GROUP BY ROLLUP (task, split, reason)",
    ),
    "leakage_assertion": (
        lambda s, d: decontam.remove_leakage(task_rows(s, d), "task").select("task", "key").intersect(decontam.eval_keys(task_rows(s, d), "task").select("task", "key")).agg(F.count("*").alias("overlap")),
        "SELECT CAST(0 AS BIGINT) AS overlap",
    ),
    "component_key_sorted": (
        lambda s, d: load(s, "benchmark", d).select("item_id", F.md5(component_key(F.concat(F.col("text"), F.lit(">>"), F.reverse(F.col("text")))).cast("binary")).alias("key")),
        r"""SELECT item_id, md5(concat_ws('>>', array_to_string(list_sort(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')), '.'),
        array_to_string(list_sort(list_filter(list_transform(string_split(reverse(text), '.'), lambda x: trim(x)), lambda x: x <> '')), '.'))) AS key FROM benchmark""",
    ),
    "bag_union": (_union, "SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY lang"),
    "union_domain": (
        lambda s, d: load(s, "customer", d).select(F.col("c_nationkey").alias("k")).union(load(s, "supplier", d).select("s_nationkey")).distinct(),
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "template_lookup": (
        lambda s, d: load(s, "documents", d).join(F.broadcast(s.createDataFrame([(t, [f"{t} a", f"{t} b", f"{t} c"]) for t in ("en", "de", "fr", "es")], "lang string, templates array<string>")), "lang").select("doc_id", F.element_at("templates", (F.col("doc_id") % 3 + 1).cast("int")).alias("template")),
        "SELECT doc_id, lang || ' ' || ['a', 'b', 'c'][doc_id % 3 + 1] AS template FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')",
    ),
    "stratified_floor": (
        lambda s, d: sampling.stratified(load(s, "documents", d), "source", 20, 2, "doc_id").select("doc_id", "source"),
        """SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)
        WHERE r <= least(n, greatest(2, CAST(round_even(n / 20.0, 0) AS BIGINT)))""",
    ),
    "sample_per_group": (
        lambda s, d: sampling.per_group(load(s, "documents", d), "lang", F.lit(7), "doc_id", 1).select("doc_id", "lang"),
        "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('1:' || doc_id), doc_id) <= 7",
    ),
    "sample_group_shuffled": (
        lambda s, d: sampling.per_group(load(s, "orders", d), "o_orderstatus", F.lit(11), "o_orderkey", 3).orderBy(sampling.hashed(4, F.col("o_orderkey"))).select("o_orderkey", "o_orderstatus"),
        "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3:' || o_orderkey), o_orderkey) <= 11",
    ),
    "replicate_factor": (
        lambda s, d: sampling.replicate(load(s, "benchmark", d).select("item_id"), 10, F.array(*[F.lit(f"t{i}") for i in range(5)]), "item_id").select("item_id", "copy", "template"),
        "SELECT item_id, CAST(c AS INTEGER) AS copy, 't' || (CAST('0x' || substr(md5((42 + c) || ':' || item_id), 1, 8) AS BIGINT) % 5) AS template FROM benchmark, range(10) r(c)",
    ),
    "self_pairing": (
        lambda s, d: sampling.paired(load(s, "documents", d), "source", "doc_id"),
        """SELECT source, doc_id, partner FROM (SELECT source, doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS partner FROM documents
        WINDOW w AS (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id)) WHERE partner <> doc_id""",
    ),
    "shard_drop_sim": (
        lambda s, d: sampling.sharded(load(s, "events", d).select("event_id"), "event_id", 6, 64).groupBy("rank", "missed").agg(F.count("*").alias("n"), F.min("event_id").alias("first")),
        """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS t FROM events), q AS (SELECT *, (t + 5) // 6 AS per, (t + 5) // 6 // 64 * 64 AS whole FROM p)
        SELECT CAST(i % 6 AS INTEGER) AS rank, NOT (i // 6 < whole OR (i + t < per * 6 AND (i + t) // 6 < whole)) AS missed, count(*) AS n, min(event_id) AS first FROM q GROUP BY ALL""",
    ),
    "outer_before_after": (
        lambda s, d: history.outer_counts(load(s, "customer", d).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")), load(s, "supplier", d).groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")), "k"),
        """SELECT k, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(b.n, 0) = coalesce(a.n, 0) AS ok
        FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)""",
    ),
}
