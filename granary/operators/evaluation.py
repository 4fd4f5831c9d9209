"""Evaluation of generated texts by task and strategy: parsing, dispatch by kind of task, partial sums and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.taxonomy import task_kind
from granary.functions.text import boolean_tag, float_tag, tag_content_open
from granary.operators import metrics
from granary.operators.rowmaps import Form, in_words
from granary.operators.texts import text_scores
from granary.sources.shared import stored

CAPTION_TAGS = ("DESCRIPTION", "IUPAC", "MOLFORMULA")


def molecule_text(s: Column, tag: str, canonical: Form = in_words) -> Column:
    """The canonical molecule of a closed or open tag, without spaces and without what is left of other tags; null if there is none."""
    inside = tag_content_open(F.replace(s, F.lit(" "), F.lit("")), tag)
    return canonical(F.split_part(F.element_at(F.split(inside, f"<{tag}>"), -1), F.lit(f"</{tag}>"), F.lit(1)))


def molecules(rows: DataFrame, by: list[str], label: Column, prediction: Column, canonical: Form = in_words) -> DataFrame:
    """Per group: n, validity, exact_match and levenshtein (of those that both sides can be read of), failure_rate; the notation is the target's."""
    selfies = label.contains("<SELFIES>")
    read = lambda s: F.when(selfies, molecule_text(s, "SELFIES", canonical)).otherwise(molecule_text(s, "SMILES", canonical))
    told = rows.select(*by, read(label).alias("a"), read(prediction).alias("b")).withColumn("ok", F.col("a").isNotNull() & F.col("b").isNotNull())
    rate = lambda x: F.coalesce(F.avg(F.when(F.col("ok"), x)), F.lit(0.0))
    failed = F.count_if(~F.col("ok")) / F.count("*")
    return told.groupBy(*by).agg(F.count("*").alias("n"), (1 - failed).alias("validity"), rate((F.col("a") == F.col("b")).cast("double")).alias("exact_match"), rate(F.levenshtein("a", "b").cast("double")).alias("levenshtein"), failed.alias("failure_rate"))


def captions(rows: DataFrame, by: list[str], label: Column, prediction: Column) -> DataFrame:
    """Per group: n, bleu2, bleu4, rouge1, rouge2, rouge_l x 100 of the rows that can be read, failure_rate. The tag is the target's first of ``CAPTION_TAGS``."""

    def read(s: Column) -> Column:
        said = F.lit(None).cast("string")
        for tag in reversed(CAPTION_TAGS):
            said = F.when(label.contains(f"<{tag}>"), tag_content_open(s, tag)).otherwise(said)
        return said

    words = lambda s: F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != "")
    told = rows.select(*by, words(read(label)).alias("ref"), words(read(prediction)).alias("hyp"))
    good = told.where("ref is not null and hyp is not null")
    out = told.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if(F.expr("ref is null or hyp is null")) / F.count("*")).alias("failure_rate"))
    return out.join(text_scores(good, by).drop("n"), by, "left").na.fill(0.0)


def evaluate(rows: DataFrame, canonical: Form = in_words) -> DataFrame:
    """(task, strategy, label_text, pred_text) -> (task, strategy, kind, metric, value), each task by its kind; name conversions have no metrics."""
    by = ["task", "strategy"]
    told = rows.withColumn("kind", task_kind(F.col("task")))
    label, said = F.col("label_text"), F.col("pred_text")
    of = lambda kind: told.where(F.col("kind") == kind)
    truth = boolean_tag(said)
    sure = F.when(truth, 1.0).when(~truth, 0.0)
    parts = {
        "classification": metrics.classification(of("classification"), by, F.when(truth.isNotNull(), boolean_tag(label)), 1 - sure, sure),
        "regression": metrics.regression(of("regression"), by, float_tag(label), float_tag(said)),
        "molecule": molecules(of("molecule"), by, label, said, canonical),
        "caption": captions(of("caption"), by, label, said),
    }
    long = [df.unpivot(by, [F.col(c).cast("double").alias(c) for c in df.columns if c not in by], "metric", "value").withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, long).select(*by, "kind", "metric", "value")


def partial_sums(rows: DataFrame, by: list[str], error: Column) -> DataFrame:
    """What a device knows of its rows: n, failed, sums of absolute and squared errors; a null error is a failure."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(error.isNull()).alias("failed"), F.coalesce(F.sum(F.abs(error)), F.lit(0.0)).alias("absolute"), F.coalesce(F.sum(error * error), F.lit(0.0)).alias("squared"))


def merged(partials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Partial sums of all devices as final metrics, a row for each known task: counts are per task, metrics without rows are NaN."""
    out = tasks.join(partials.groupBy("task").agg(*[F.sum(c).alias(c) for c in ("n", "failed", "absolute", "squared")]), "task", "left").na.fill(0)
    valid = F.nullif(F.col("n") - F.col("failed"), F.lit(0))
    safe = lambda x: F.coalesce(x, F.lit(float("nan")))
    return out.select("task", "n", safe(F.col("absolute") / valid).alias("mae"), safe(F.sqrt(F.col("squared") / valid)).alias("rmse"), safe(F.col("failed") / F.nullif("n", F.lit(0))).alias("failure_rate"))


def preference_score(theta_w: Column, ref_w: Column, theta_l: Column, ref_l: Column, beta: float) -> Column:
    """How much more than its reference the model prefers the chosen answer to the rejected."""
    return beta * (theta_w - ref_w) - beta * (theta_l - ref_l)


def total_loss(sft: Column, preference: Column, anchor: Column, sft_weight: float = 1.0, preference_weight: float = 0.25, anchor_weight: float = 0.0) -> Column:
    """Weighted sum of losses; a null supervised loss counts nothing."""
    return preference_weight * preference + anchor_weight * anchor + sft_weight * F.coalesce(sft, F.lit(0.0))


def check_steps(length: int, block: int, steps: int) -> int:
    """Steps per block of a blockwise generation; fails where blocks don't fit or steps don't divide."""
    blocks = length // block
    if not blocks:
        raise ValueError(f"a block of {block} is longer than {length}")
    if steps % blocks:
        raise ValueError(f"{steps} steps can't be shared by {blocks} blocks")
    return steps // blocks


def paired_slots(rows: DataFrame, prompt: Column, chosen: Column, rejected: Column, most: int, end: int, division: int = 2, require: bool = False, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(slots, counts): token arrays of pairs as two or three rows each, and how many rows were left out and why.

    Slots are chosen and rejected, and with ``division`` 3 the supervised copy of the chosen first; a slot is prompt, answer and
    ``end``, cut at ``most`` and padded with ``end``; labels are -100 over the prompt. Rows without a pair or with an answer that the
    cut leaves empty are counted (for each batch ``by``); with ``require`` a missing pair fails the query. ``check_pairs`` fails where none is kept.
    """
    if division not in (2, 3):
        raise ValueError("pairs take two or three slots")
    missing = chosen.isNull() | rejected.isNull()
    empty = (F.size(prompt) >= most) | (F.size(chosen) == 0) | (F.size(rejected) == 0)
    why = F.when(missing, "no pair").when(empty, "empty answer")
    if require:
        why = F.when(missing, F.raise_error(F.lit("a row has no pair"))).otherwise(why)
    told = rows.withColumn("_why", why)
    counts = told.groupBy(*[by] * bool(by), F.coalesce("_why", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
    names = [("sft", chosen)] * (division == 3) + [("chosen", chosen), ("rejected", rejected)]
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(n).alias("role"), a.alias("answer")) for k, (n, a) in enumerate(names)])
    split = told.where("_why is null").withColumn("_s", F.explode(slots))
    whole = F.slice(F.concat(prompt, F.col("_s.answer"), F.array(F.lit(end))), 1, most)
    ids = F.concat(whole, F.array_repeat(F.lit(end), F.lit(most) - F.size(whole)))
    asked = F.least(F.size(prompt), F.lit(most))
    labels = F.concat(F.array_repeat(F.lit(-100), asked), F.slice(ids, asked + 1, F.lit(most)))
    return split.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_s.slot").alias("slot"), F.col("_s.role").alias("role"), ids.alias("ids"), labels.alias("labels")), counts


def check_pairs(counts: DataFrame, by: str | None = None) -> DataFrame:
    """(by, kept, left_out) of each batch of ``counts`` (by, outcome, n); fails, naming the batches, where a batch has rows but none is kept."""
    keys = [by] if by else []
    told = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("outcome") == "kept", F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(F.col("outcome") != "kept", F.col("n"))), F.lit(0)).alias("left_out"))
    empty = told.where("kept = 0 and left_out > 0").limit(10).collect()
    if empty:
        raise ValueError("every pair is left out" + (f" of batch {', '.join(str(r[by]) for r in empty)}" if by else ""))
    return told


def steps_per_block(length: Column, block: Column, steps: Column) -> Column:
    """As ``check_steps``, of columns: null where no block fits or steps don't divide."""
    blocks = F.floor(length / block)
    return F.when((blocks > 0) & (steps % blocks == 0), F.floor(steps / blocks)).cast("int")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the last ``value`` of its group at or before its time.

    Both sides are one stream, cut into stored ranges of (group, time). Inside a range a window carries the last value on; where a
    range begins without one, the last value of the ranges before it is taken, so a group of many rows isn't one task's work.
    """
    kind = right.schema[value].dataType
    told = F.struct(F.lit(1).alias("seen"), F.col(value).cast(kind).alias("v"))
    both = left.select("*", F.lit(None).cast(f"struct<seen:int,v:{kind.simpleString()}>").alias("_v"), F.lit(1).alias("_side")).unionByName(right.where(F.col(value).isNotNull()).select(by, at, told.alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(both.repartitionByRange(width, by, at, "_side").withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy(F.col(by).alias("_g"), F.col("_part").alias("_p")).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_end"))
    carried = ends.select("_g", "_p", F.last("_end", ignorenulls=True).over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    upto = Window.partitionBy(by, "_part").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("_in", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1")
    met = inside.join(carried, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    return met.select(*left.columns, F.coalesce("_in", "_carry")["v"].alias("as_of"))


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, expected, observed, status): counts of both sides, 0 where a key is missing, OK or DIFF."""
    a, b = expected.groupBy(key).agg(F.count("*").alias("expected")), observed.groupBy(key).agg(F.count("*").alias("observed"))
    out = a.join(b, key, "full_outer").na.fill(0, ["expected", "observed"])
    return out.withColumn("status", F.when(F.col("expected") == F.col("observed"), "OK").otherwise("DIFF"))
