"""Training-side arithmetic over rows: collation, losses, preference scores, schedules, message passing."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import history


def collate(prompt: Column, answer: Column, eos: int, pad: int, width: int) -> Column:
    """Prompt + answer + eos cut and right-padded to ``width``, with labels of -100 off the answer."""
    ids = F.slice(F.concat(prompt, answer, F.array(F.lit(eos))), 1, width)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer, F.array(F.lit(eos))), 1, width)
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.lit(width) - F.size(x)))
    return F.struct(fill(ids, pad).alias("input_ids"), fill(labels, -100).alias("labels"), F.size(ids).alias("length"))


def left_pad(df: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """Left-pad ids to the longest of their batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    return df.join(longest, batch).withColumn(ids, F.concat(F.array_repeat(F.lit(pad), F.col("_longest") - F.size(ids)), F.col(ids))).drop("_longest")


def masked_loss(rows: DataFrame, by: list[str], nll: str, p: str, length: str) -> DataFrame:
    """Per group: mean over rows of sum nll/p over masked tokens by answer length."""
    return rows.groupBy(*by, "row").agg((F.sum(F.col(nll) / F.col(p)) / F.max(length)).alias("loss")).groupBy(*by).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def elbo(rows: DataFrame, item: str, draw: str, nll: str, p: str, length: str) -> DataFrame:
    """(item, elbo): mean over draws of -sum(nll / p) / length."""
    return rows.groupBy(item, draw).agg((-F.sum(F.col(nll) / F.col(p)) / F.max(length)).alias("e")).groupBy(item).agg(F.avg("e").alias("elbo"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(r_w: Column, r_l: Column, gamma: Column, clip: float, hinge: bool = False) -> Column:
    """-log sigmoid of the clipped margin less gamma, or its hinge."""
    margin = F.greatest(F.lit(-clip), F.least(F.lit(clip), r_w - r_l)) - gamma
    return F.greatest(F.lit(0.0), -margin) if hinge else softplus(-margin)


def pair_softmax(a: Column, b: Column, len_a: Column, len_b: Column) -> Column:
    """Probability of the second of two candidates from length-normalised log likelihoods."""
    return 1 / (1 + F.exp(a / len_a - b / len_b))


def mask_bucket(x: Column, edges=(0.2, 0.4, 0.6, 0.8)) -> Column:
    """Bucket of a mask ratio; an edge belongs to the lower one."""
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(x <= e, i).otherwise(out)
    return out


def learning_rate(step: Column, peak: float, least: float, warmup: int, stable: int, decay: int) -> Column:
    """Warm-up, plateau, linear decay, floor."""
    after = step - warmup - stable
    return F.when(step < warmup, peak * step / max(warmup, 1)).when(after < 0, peak).when(after < decay, peak - (peak - least) * after / decay).otherwise(least)


def uniform(*cols: Column) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of an md5; the same for the same columns everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mask_tokens(rows: DataFrame, scope: str, pos: str, p: Column) -> DataFrame:
    """Rows with ``masked``: hash-uniform below p, and the lowest draw of a scope where none is."""
    u = uniform(F.col(scope), F.col(pos))
    drawn = rows.withColumn("u", u).withColumn("p", p)
    w = Window.partitionBy(scope)
    hit = (F.col("u") < F.col("p")).cast("int")
    lone = (F.max(hit).over(w) == 0) & (F.row_number().over(w.orderBy("u", pos)) == 1)
    return drawn.withColumn("masked", (hit == 1) | lone)


def message_pass(edges: DataFrame, nodes: DataFrame, self_loops: bool = True, mean: bool = False) -> DataFrame:
    """(node, value): sum or mean of neighbours' values over (src, dst) edges."""
    if self_loops:
        edges = edges.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    met = edges.join(nodes, edges.src == nodes.node)
    return met.groupBy(F.col("dst").alias("node")).agg((F.avg if mean else F.sum)("value").alias("value"))




def masked_metrics(rows: DataFrame, row: str, nll: Column, p: Column, length: Column, right: Column, end: Column) -> DataFrame:
    """Per row, over its masked tokens: loss and accuracy, and both without the tokens that are ``end``; ``length`` counts all of the answer.

    The loss without ends is divided by the answer's length less its ends, by 1 at least.
    """
    rest = F.when(~end, nll / p)
    ends = F.count_if(end)
    return rows.groupBy(row).agg(
        (F.sum(nll / p) / F.max(length)).alias("loss"), (F.coalesce(F.sum(rest), F.lit(0.0)) / F.greatest(F.max(length) - ends, F.lit(1))).alias("loss_no_end"),
        F.avg(right.cast("double")).alias("accuracy"), F.coalesce(F.avg(F.when(~end, right.cast("double"))), F.lit(0.0)).alias("accuracy_no_end"),
    )


def anchored_preferences(rows: DataFrame, task: str, batch: str, order: str, columns: tuple[str, str, str, str], beta: float = 0.1, scale: float = 0.5, alpha: float = 0.99, clip: float | None = None, rejected: float = 1.5, hinge: bool = False) -> DataFrame:
    """``rows`` with ``average``, the task's moving mean of chosen rewards after their batch, what ``preference_rows`` tells with it, and the
    ``anchor`` loss that holds the rejected answer below ``rejected`` times that mean. ``columns`` are the bounds of the chosen under model and
    reference and of the rejected under both. ``hinge`` replaces the logistic loss by max(0, 1 - (margin - gamma))."""
    theta_w, ref_w, theta_l, ref_l = map(F.col, columns)
    rewarded = rows.withColumn("_r", (beta * (theta_w - ref_w)).cast("double"))
    running = history.running_mean(rewarded, task, [batch, order], "_r", alpha)
    last = running.groupBy(F.col(task).alias("_t"), F.col(batch).alias("_b")).agg(F.max_by("ema", order).alias("average"))
    met = running.drop("ema").join(last, F.col(task).eqNullSafe(F.col("_t")) & F.col(batch).eqNullSafe(F.col("_b")))
    told = met.withColumn("_p", preference_rows(theta_w, ref_w, theta_l, ref_l, F.col("average"), beta, scale, clip))
    gap = F.col("_p.margin") - F.col("_p.gamma")
    loss = F.greatest(F.lit(0.0), 1 - gap) if hinge else F.col("_p.loss")
    return told.select(*rows.columns, "average", "_p.r_w", "_p.r_l", "_p.margin", "_p.gamma", loss.alias("loss"), softplus(F.col("_p.r_l") - rejected * F.col("average")).alias("anchor"), "_p.right")


def preference_rows(theta_w: Column, ref_w: Column, theta_l: Column, ref_l: Column, average: Column, beta: float = 0.1, scale: float = 0.5, clip: float | None = None) -> Column:
    """(r_w, r_l, margin, gamma, loss, right): rewards against the reference, the margin clipped to ``clip`` times the chosen reward,
    a margin wanted of ``scale`` times the task's average reward, the logistic loss, and whether the chosen answer wins."""
    r_w, r_l = beta * (theta_w - ref_w), beta * (theta_l - ref_l)
    raw = r_w - r_l
    margin = raw if clip is None else F.greatest(-clip * F.abs(r_w), F.least(clip * F.abs(r_w), raw))
    gamma = scale * F.abs(F.coalesce(average, F.lit(0.0)))
    return F.struct(r_w.alias("r_w"), r_l.alias("r_l"), margin.alias("margin"), gamma.alias("gamma"), softplus(gamma - margin).alias("loss"), (raw > 0).alias("right"))
