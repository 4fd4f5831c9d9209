"""The stand-ins that queries share: documents as task rows, scores and predictions derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import entity_key
from granary.sources.shared import scratch as scratch
from granary.sources.tables import hashed_split, load

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def task_rows(spark: SparkSession, sf: str) -> DataFrame:
    """documents as (doc_id, task = lang, split by md5, source, n_chars, key = md5 of the normalised text)."""
    return load(spark, "documents", sf).select(
        "doc_id", F.col("lang").alias("task"), hashed_split(F.col("doc_id")).alias("split"), "source", "n_chars", F.md5(entity_key(F.col("text")).cast("binary")).alias("key"), "text"
    )


TASK_ROWS = r"""task_rows AS (
  SELECT doc_id, lang AS task, CASE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) WHEN '0' THEN 'test' WHEN '1' THEN 'val' ELSE 'train' END AS split,
    source, n_chars, md5(CASE WHEN k IN ('', '<none>') THEN NULL ELSE k END) AS key, text
  FROM (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """labels beside a deterministic score: (doc_id, task, y, p in [0, 1))."""
    docs = load(spark, "documents", sf).select("doc_id", F.col("lang").alias("task"), "n_chars")
    return load(spark, "labels", sf).join(docs, "doc_id").select("doc_id", "task", F.col("quality").alias("y"), F.col("toxic"), ((F.col("n_chars") % 97) / F.lit(97.0)).alias("p"), "n_chars")


SCORED = "scored AS (SELECT l.doc_id, d.lang AS task, l.quality AS y, l.toxic, (d.n_chars % 97) / 97.0 AS p, d.n_chars FROM labels l JOIN documents d USING (doc_id))"

#: Captions: a whole text without its last two words against the same without its first two.
PAIRS = r"""pairs AS (SELECT doc_id, lang AS task, list_slice(w, 1, greatest(len(w) - 2, 0)) AS ref, list_slice(w, 3, len(w)) AS hyp FROM (SELECT doc_id, lang, list_filter(string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents))"""


def caption_pairs(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"\s+", " "), " "), lambda w: w != "")
    return load(spark, "documents", sf).select("doc_id", F.col("lang").alias("task"), words.alias("w")).select("doc_id", "task", *_shifted())


def _shifted():
    rest = F.greatest(F.size("w") - 2, F.lit(0))
    return F.slice("w", F.lit(1), rest).alias("ref"), F.slice("w", F.lit(3), rest).alias("hyp")
