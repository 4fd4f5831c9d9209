"""Corruption with retries and best-of-N, on benchmark texts as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.chemistry import canonicalizer
from granary.operators import augment
from granary.plans.common import Query
from granary.sources.tables import load


def _tried(s, d, tries=6):
    words = load(s, "benchmark", d).select("item_id", F.split("text", " ").alias("w"))
    out = augment.attempts(words, tries)
    cut = augment.drop_words(F.col("w"), F.col("seed"), 0.3)
    return out.withColumn("c", cut).withColumn("s", augment.overlap(F.col("w"), F.col("c")))


TRIED = """tried AS (SELECT *, len(list_intersect(w, c)) / len(list_distinct(w || c)) AS s FROM (SELECT item_id, w, attempt, list_filter(w, lambda x: CAST('0x' || substr(md5((42 + attempt * 7919) || ':' || x), 1, 13) AS BIGINT) / 4503599627370496.0 >= 0.3) AS c
  FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), range(6) r(attempt)))"""


def _best(s, d):
    return augment.best_of(_tried(s, d), "item_id", F.col("s"), F.size("c"), 0.7, 0.05).withColumn("similarity", F.round("similarity", 9))


def _first(s, d):
    reason = F.when(F.size("c") < 10, "below_min").when(~F.col("s").between(0.6, 0.72), "out_of_band").otherwise("ok")
    return augment.first_success(_tried(s, d), "item_id", reason, F.size("c"))


def _rebuilt(s, d):
    prompt = T.prompt(T.fill_instruction(F.lit("Old <INPUT>"), F.col("n_name")), "Sys", "mistral")
    return load(s, "nation", d).select("n_nationkey", F.md5(augment.rebuild_user_part(prompt, F.concat(F.lit("New "), F.col("n_name"))).cast("binary")).alias("p"))


QUERIES: dict[str, Query] = {
    "best_of_n_band": (
        _best,
        f"""WITH {TRIED} SELECT item_id, CAST(len(c) AS INTEGER) AS result, round(s, 9) AS similarity, abs(s - 0.7) <= 0.05 + 1e-12 AS in_band, CAST(attempt + 1 AS INTEGER) AS n FROM tried
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY abs(s - 0.7) > 0.05 + 1e-12, CASE WHEN abs(s - 0.7) <= 0.05 + 1e-12 THEN 0 ELSE abs(s - 0.7) END, attempt) = 1""",
    ),
    "retry_first_success": (
        _first,
        f"""WITH {TRIED}, r AS (SELECT *, CASE WHEN len(c) < 10 THEN 'below_min' WHEN NOT s BETWEEN 0.6 AND 0.72 THEN 'out_of_band' ELSE 'ok' END AS reason FROM tried)
        SELECT item_id, reason, CASE WHEN reason = 'ok' THEN CAST(len(c) AS INTEGER) END AS result, CAST(attempt + 1 AS INTEGER) AS n FROM r
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY reason <> 'ok', CASE WHEN reason = 'ok' THEN attempt ELSE -attempt END) = 1""",
    ),
    "corrupt_variants": (
        lambda s, d: augment.variants(augment.attempts(load(s, "benchmark", d).select("item_id", F.split("text", " ").alias("w")), 6), "item_id", lambda w, seed: augment.drop_words(w, seed, 0.3), F.col("w")).select("item_id", F.md5(F.array_join(F.flatten("variants"), " ").cast("binary")).alias("v")),
        f"WITH {TRIED} SELECT item_id, md5(array_to_string(flatten(list(c ORDER BY attempt)), ' ')) AS v FROM tried GROUP BY item_id",
    ),
    "rebuild_user_part": (
        _rebuilt,
        "SELECT n_nationkey, md5('<s>[INST] Sys ' || chr(10) || chr(10) || 'New ' || n_name || '<GRAPH>' || repeat('<mol>', 32) || '</GRAPH> [/INST] ') AS p FROM nation",
    ),
    "canonical_text_form": (
        lambda s, d: load(s, "part", d).select("p_partkey", canonicalizer("text")(F.concat(F.lit(" "), F.col("p_name"), F.lit("  x"))).alias("c")),
        r"SELECT p_partkey, trim(regexp_replace(' ' || p_name || '  x', '\s+', ' ', 'g')) AS c FROM part",
    ),
}
