"""The training-corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's rows as
Parquet in the shared folder and reads them again. All but the last return the columns of ``documents``, under any names beside
doc_id, text and n_chars. Rows with a null doc_id are never filtered out by what is decided by id (the toxicity of a text isn't),
and are packed at the end. Null and empty texts pass every stage; without labels or benchmark items their stages reject nothing;
identical rows of one id are kept or rejected together; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import stored, table
from granary.llm.decontam import contamination
from granary.llm.lines import dedup_lines
from granary.llm.packing import pack_documents
from granary.llm.simhash import near_duplicates
from granary.llm.toxicity import held_out, learn, scored

TOXIC = 0.7


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``."""
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = fresh(docs, "score")
    return scored(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each class of like lines; documents that lose every line they had go. n_chars follows the text."""
    lines, removed = fresh(docs, "lines_read"), fresh(docs, "lines_removed")
    found = dedup_lines(docs, counts=(lines, removed))
    emptied = (F.col(removed) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = found.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near copies; identical rows of one id are one document."""
    found = near_duplicates(docs)
    gone = found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule doesn't call contaminated."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
