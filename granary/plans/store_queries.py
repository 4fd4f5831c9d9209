"""Sinks written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import history
from granary.plans.common import Query, scratch
from granary.sources import sinks, tables
from granary.sources.tables import load


def _rank_logs(s, d):
    """Prediction logs of six ranks as JSON lines, merged in rank order with first-wins dedup."""
    at = scratch(s)
    e = load(s, "events", d).select(F.col("user_id").alias("val_idx"), F.col("event_type").alias("strategy"), F.col("event_id").alias("line"), (F.col("event_id") % 6).alias("rank"))
    e.write.partitionBy("rank").json(f"{at}/log")
    schema = "val_idx long, strategy string, line long"
    ranks = [tables.json_lines(s, f"{at}/log/rank={r}", schema).withColumn("rank", F.lit(r)) for r in range(6)]
    rows = ranks[0]
    for r in ranks[1:]:
        rows = rows.unionByName(r)
    return history.merge_first(rows.drop("file"), ["val_idx", "strategy"], ["rank", "line"], "val_idx").groupBy("strategy").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def _csv(s, d):
    at = scratch(s)
    load(s, "nation", d).write.option("header", True).csv(at)
    return tables.load_or_csv(s, f"{at}/missing", at, "n_nationkey int, n_name string, n_regionkey int")


def _failures(s, d):
    at = scratch(s)
    sinks.write_failures(load(s, "events", d).select("event_id", "event_type", "value"), F.col("value") > 100, at, "event_type")
    return s.read.schema("event_id long, value double, event_type string").json(at).groupBy("event_type").agg(F.count("*").alias("n"))


def _replaced(s, d):
    at = scratch(s)
    first = sinks.write_once(load(s, "region", d), at)
    again = sinks.write_once(load(s, "region", d).limit(1), at)
    kept = s.read.parquet(at).count()
    sinks.replace(load(s, "nation", d), at)
    return s.read.parquet(at).agg(F.count("*").alias("after")).select(F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(kept).cast("long").alias("kept"), "after")


def _splits(s, d):
    at = scratch(s)
    rows = load(s, "documents", d).select("doc_id", "lang", tables.hashed_split(F.col("doc_id")).alias("split"))
    sinks.write_splits(rows, at, "split")
    return s.read.parquet(at).where("split = 'train'").groupBy("lang").agg(F.count("*").alias("n"))


def _folder_names(s, d):
    """Folders of subtasks and splits, found by their names; rows of subtasks are summed."""
    at = scratch(s)
    for task, subtask, split, low in (("bace", "0", "train", 0), ("bace", "0", "val", 5), ("tox", "1", "train", 10), ("tox", "2", "train", 15), ("tox", "multi_label_classification", "test", 20)):
        load(s, "nation", d).where(F.col("n_nationkey") >= low).write.parquet(f"{at}/{task}_subtask-{subtask}_{split}")
    load(s, "region", d).write.parquet(f"{at}/other")
    return tables.subtask_counts(s, at)


def _shards(s, d):
    at = scratch(s)
    load(s, "nation", d).write.parquet(f"{at}/some")
    sinks.append_lines(load(s, "region", d), f"{at}/none")
    sinks.remove(s, f"{at}/gone")
    counts = [(name, tables.shard_rows(s, f"{at}/{name}")) for name in ("some", "missing")]
    return s.createDataFrame(counts, "name string, n long")


def _appended(s, d):
    at = scratch(s)
    e = load(s, "events", d).select("event_id", "event_type")
    sinks.append_lines(e.where("event_id % 2 = 0"), at)
    sinks.append_lines(e.where("event_id % 2 = 1"), at)
    return s.read.schema("event_id long, event_type string").json(at).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _csv_written(s, d):
    at = scratch(s)
    rows = load(s, "nation", d).select("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.when(F.col("n_nationkey") % 3 > 1, F.col("n_name")).otherwise("")).alias("name"))
    sinks.write_csv(rows, at, "name")
    return s.read.schema("n_nationkey int, name string").csv(at, header=True)


def _history(s, d):
    at = scratch(s)
    step = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "x").otherwise(F.col("event_id").cast("string"))
    cell = F.when(F.col("event_id") % 4 == 0, "NaN").when(F.col("event_id") % 4 == 1, "").otherwise((F.col("event_id") * 2).cast("string"))
    load(s, "events", d).select(step.alias("_step"), F.lit("1").alias("epoch"), cell.alias("val/loss")).write.csv(at, header=True)
    return tables.run_history(s, at, ["val/loss", "val/none"]).withColumnsRenamed({"val/loss": "loss", "val/none": "none"})


def _vocabulary(s, d):
    at = scratch(s)
    load(s, "part", d).select(F.concat(F.lit(" "), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).otherwise(""), F.lit(" "))).write.text(at)
    return tables.vocabulary(s, at)


def _predictions(s, d):
    at = scratch(s)
    rows = load(s, "events", d).select(F.when(F.col("event_id") % 2 == 0, "classification").otherwise("generation").alias("part"), F.col("event_id").alias("val_idx"), F.col("event_type").alias("task"))
    sinks.write_predictions(rows, at, 2.0, 7)
    return tables.prediction_parts(s, at, "val_idx long, task string").groupBy("part", "task", "epoch", "global_step").agg(F.count("*").alias("n"), F.sum("val_idx").alias("ids"))


def _report(s, d):
    told = sinks.markdown(load(s, "region", d).select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return s.createDataFrame([(told,)], "report string")


QUERIES: dict[str, Query] = {
    "jsonl_rank_merge": (
        _rank_logs,
        """SELECT strategy, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM (SELECT user_id AS val_idx, event_type AS strategy, event_id AS line FROM events
        QUALIFY user_id < 0 OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 6, event_id) = 1) GROUP BY strategy""",
    ),
    "csv_fallback_scan": (_csv, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "failure_json_groups": (_failures, "SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type"),
    "write_once_then_replace": (_replaced, "SELECT true AS first, false AS again, (SELECT count(*) FROM region) AS kept, (SELECT count(*) FROM nation) AS after"),
    "partitioned_splits": (_splits, "SELECT lang, count(*) AS n FROM documents WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) NOT IN ('0', '1') GROUP BY lang"),
    "folder_name_discovery": (
        _folder_names,
        """SELECT task, split, CAST(sum(n) AS BIGINT) AS n FROM (SELECT t.task, t.split, (SELECT count(*) FROM nation WHERE n_nationkey >= t.low) AS n
        FROM (VALUES ('bace', 'train', 0), ('bace', 'val', 5), ('tox', 'train', 10), ('tox', 'train', 15), ('tox', 'test', 20)) t(task, split, low)) GROUP BY task, split""",
    ),
    "shard_rows": (_shards, "SELECT 'some' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'missing', NULL"),
    "append_lines": (_appended, "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"),
    "write_csv_needed": (_csv_written, "SELECT n_nationkey, n_name AS name FROM nation WHERE n_nationkey % 3 = 2"),
    "run_history_scan": (
        _history,
        "SELECT event_id AS _step, 1.0::DOUBLE AS epoch, CASE WHEN event_id % 4 > 1 THEN CAST(event_id * 2 AS DOUBLE) END AS loss, CAST(NULL AS DOUBLE) AS none FROM events WHERE event_id % 10 > 1",
    ),
    "vocabulary_scan": (_vocabulary, "SELECT DISTINCT trim(p_type) AS token FROM part WHERE p_partkey % 5 > 0"),
    "prediction_json_scan": (
        _predictions,
        "SELECT CASE event_id % 2 WHEN 0 THEN 'classification' ELSE 'generation' END AS part, event_type AS task, 2.0::DOUBLE AS epoch, CAST(7 AS BIGINT) AS global_step, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL",
    ),
    "markdown_report": (
        _report,
        "SELECT '| r_regionkey | r_name |' || chr(10) || '| - | - |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10), '' ORDER BY r_regionkey) AS report FROM region",
    ),
}
