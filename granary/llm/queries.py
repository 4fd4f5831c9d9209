"""Thin queries over the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table
from granary.llm.oracles import ORACLES


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.chat import as_events, audit, fold, format_turns

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return audit(format_turns(fold(as_events(rows))), in_order=True).withColumnRenamed("conv", "conv_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.toxicity import held_out, learn, tag

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = tag(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.extraction import extract

    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.neighbours import link_vectors

    found = link_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "words", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.lines import SHORT, dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=SHORT)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents")).withColumn("length", F.col("length").cast("long"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine(rows, F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quantize import compress, digest, label_errors

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
