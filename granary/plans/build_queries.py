"""Build steps over shards, ranks, splits and stages, and streams that flush and set aside; each written, run and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import splits
from granary.plans.common import Query, scratch
from granary.sources import arrow, barrier, linked, sinks, stages
from granary.sources.tables import hashed_split, load
from granary.streaming import flush, letters, logs


def _scan(s, d):
    at = scratch(s)
    docs = load(s, "documents", d)
    arrow.write_shards(docs.where("doc_id % 2 = 0"), at)
    arrow.write_shards(docs.where("doc_id % 2 = 1"), at, ipc="stream")
    return arrow.read_shards(s, at, f"{at}/missing").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max(F.md5("text")).alias("last"))


def _counts(s, d):
    at = scratch(s)
    docs = load(s, "documents", d).repartition(5, "doc_id")
    arrow.write_shards(docs, at)
    return arrow.count_shards(s, at).agg(F.sum("rows").alias("n"), (F.count("*") <= 5).alias("a_shard_each"))


def _group_split(s, d):
    rows = load(s, "documents", d).select("doc_id", F.substring("text", 1, 3).alias("key"))
    return splits.split_groups(rows, "key", "doc_id").select("doc_id", "split")


GROUP_SPLIT = """WITH RECURSIVE d AS (SELECT doc_id, substring(text, 1, 3) AS k FROM documents), g AS (SELECT k, count(*) AS z, min(doc_id) AS f FROM d GROUP BY k),
r AS (SELECT *, row_number() OVER (ORDER BY z DESC, f DESC) AS i FROM g), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, '' AS split UNION ALL
  SELECT r.i, CASE WHEN a + z <= 0.8::DOUBLE * n + 1e-6 THEN a + z ELSE a END, CASE WHEN a + z > 0.8::DOUBLE * n + 1e-6 AND a + b + z <= 0.9::DOUBLE * n + 1e-6 THEN b + z ELSE b END,
  CASE WHEN a + z <= 0.8::DOUBLE * n + 1e-6 THEN 'train' WHEN a + b + z <= 0.9::DOUBLE * n + 1e-6 THEN 'val' ELSE 'test' END FROM w JOIN r ON r.i = w.i + 1, n)
SELECT doc_id, split FROM d JOIN r ON d.k IS NOT DISTINCT FROM r.k JOIN w USING (i)"""


def _ranks(s, d):
    at = scratch(s)
    barrier.write_ranks(load(s, "events", d).select("event_id", "event_type"), at, 2, "event_id")
    return arrow.read_shards(s, at).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _long(spark: SparkSession, docs: DataFrame, least: int) -> DataFrame:
    return docs.where(F.col("n_chars") >= least)


def _by_language(spark: SparkSession, kept: DataFrame) -> DataFrame:
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _lost(spark: SparkSession, kept: DataFrame) -> DataFrame:
    return kept.select(F.raise_error(F.lit("the build breaks off here")).alias("x"))


def _resumed(s, d):
    """A build that breaks off, goes on, and is run again with a further file and with another setting: which stages ran, and what they gave."""
    at = scratch(s)
    docs = load(s, "documents", d).select("doc_id", "lang", "n_chars")
    docs.where("doc_id % 10 > 0").write.parquet(f"{at}/docs")
    told = []

    def build(attempt, last=_by_language, least=500):
        done = stages.Stages(s, f"{at}/build")
        try:
            done.run("kept", _long, {"docs": f"{at}/docs"}, least=least)
            done.run("languages", last, after=["kept"])
        except Exception:  # noqa: BLE001
            done.ran.append("broken off")
        told.extend((attempt, name, name in done.ran) for name in (*done.skipped, *done.ran))
        return done.table("languages").select(F.lit(attempt).alias("attempt"), "lang", "n", "chars") if "broken off" not in done.ran else None

    build(1, _lost)
    tables = [written(build(2), f"{at}/2"), written(build(3), f"{at}/3")]
    docs.where("doc_id % 10 = 0").write.mode("append").parquet(f"{at}/docs")
    tables += [written(build(4), f"{at}/4"), written(build(5, least=2000), f"{at}/5")]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])
    ran = s.createDataFrame([(a, sum(r for b, _, r in told if a == b)) for a in (2, 3, 4, 5)], "of int, stages_run int")
    return rows.join(ran, F.col("attempt") == F.col("of")).select("attempt", "stages_run", "lang", "n", "chars")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _linked(s, d):
    at = scratch(s)
    rows = load(s, "documents", d).select("doc_id", "lang", hashed_split(F.col("doc_id")).alias("split"))
    for name in ("train", "val", "test"):
        rows.where(F.col("split") == name).drop("split").write.parquet(f"{at}/all/{name}")
    told = linked.link_subset(f"{at}/all", f"{at}/sub", "test", linked.read_split(s, f"{at}/all", "test").where("doc_id % 3 = 0"))
    own = {name: any("/sub/" in f for f in files) for name, files in told.items()}
    parts = [linked.read_split(s, f"{at}/sub", name).select(F.lit(name).alias("split"), F.lit(own[name]).alias("own"), "doc_id") for name in sorted(told)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split", "own").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def _parts(s, d, at, columns, n=5):
    """events as ``n`` appends in order of their ids, and how many ids an append spans."""
    e = load(s, "events", d)
    last = e.agg(F.max("event_id")).first()[0] or 0
    width = last // n + 1
    for k in range(n):
        sinks.append_lines(e.where(F.floor(F.col("event_id") / width) == k).select(*columns), at)
        yield width, last


def _flushed(s, d):
    """Interval means of a stream that is stopped and started again after each append; a mark ends the epoch."""
    at, out = scratch(s), []
    columns = [F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value"]
    schema = "key string, step long, value double"

    def run(width):
        with flush.rocks(s):
            stream = flush.interval_means(logs.log_stream(s, f"{at}/in", schema), "key", "step", "value", 500, width)
            logs.append_once(stream, f"{at}/out", f"{at}/log").awaitTermination()

    for width, last in _parts(s, d, f"{at}/in", columns):
        out.append((width, last))
        run(width)
    width, last = out[-1]
    sinks.append_lines(s.createDataFrame([(None, last + 500 + 2 * width, None)], schema), f"{at}/in")
    run(width)
    told = s.read.schema(f"{flush.MEANS}, batch int").option("basePath", f"{at}/out").parquet(f"{at}/out")
    return told.select(F.col("key").alias("event_type"), "flush", "n", F.round("mean", 4).alias("mean"))


def _checked(batch: DataFrame) -> DataFrame:
    poison = F.when(F.col("event_id") == 3, F.raise_error(F.lit("a value that no aggregate takes")).cast("long")).otherwise(F.col("event_id"))
    return batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(poison).alias("ids"))


def _set_aside(s, d):
    at = scratch(s)
    for _ in _parts(s, d, f"{at}/in", ["event_id", "event_type"]):
        letters.guarded(logs.log_stream(s, f"{at}/in", "event_id long, event_type string", 10_000), _checked, f"{at}/out", f"{at}/log").awaitTermination()
    done = letters.letters(s, f"{at}/out", "done", "event_type string, n long, ids long").select(F.lit("done").alias("kind"), "n", "ids")
    dead = letters.letters(s, f"{at}/out", "dead", "event_id long, event_type string, _error string").select(F.lit("dead").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("ids"))
    return done.unionByName(dead).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


QUERIES: dict[str, Query] = {
    "arrow_scan": (_scan, "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(md5(text)) AS last FROM documents GROUP BY lang"),
    "arrow_shard_counts": (_counts, "SELECT count(*) AS n, true AS a_shard_each FROM documents"),
    "group_split": (_group_split, GROUP_SPLIT),
    "rank_files_barrier": (_ranks, "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"),
    "stages_resumed": (
        _resumed,
        """SELECT attempt, stages_run, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents, (VALUES (2, 1, 1, 500), (3, 0, 1, 500), (4, 2, 0, 500), (5, 2, 0, 2000)) a(attempt, stages_run, low, least)
        WHERE doc_id % 10 >= low AND n_chars >= least GROUP BY ALL""",
    ),
    "linked_subset": (
        _linked,
        """SELECT split, split = 'test' AS own, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) WHEN '0' THEN 'test' WHEN '1' THEN 'val' ELSE 'train' END AS split FROM documents)
        WHERE split <> 'test' OR doc_id % 3 = 0 GROUP BY ALL""",
    ),
    "stream_interval_flush": (_flushed, "SELECT event_type, event_id // 500 AS flush, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL"),
    "stream_dead_letters": (
        _set_aside,
        "SELECT CASE WHEN event_id // w = 0 THEN 'dead' ELSE 'done' END AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events, (SELECT max(event_id) // 5 + 1 AS w FROM events) GROUP BY ALL",
    ),
}
