"""Evaluation aggregates and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import history, metrics, texts
from granary.plans.common import PAIRS, SCORED, Query, caption_pairs, scored
from granary.sources.tables import load


def _rounded(df, *cols, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in cols else F.col(c) for c in df.columns])


def _events(s, d):
    return load(s, "events", d)


def _classified(s, d):
    return _rounded(metrics.classification(scored(s, d), ["task"], F.when(F.col("n_chars") % 11 != 0, F.col("y")), 1 - F.col("p"), F.col("p")), "accuracy", "precision", "recall", "f1", "roc_auc", "failure_rate")


CLASSIFIED = f"""WITH {SCORED}, b AS (SELECT task, CASE WHEN n_chars % 11 <> 0 THEN y END AS y, CASE WHEN p > 1 - p THEN 1 ELSE 0 END AS pr, p FROM scored),
c AS (SELECT task, count(*) AS n, count(y) AS v, count(*) FILTER (y = pr) AS ok, count(*) FILTER (y = 1 AND pr = 1) AS tp, count(*) FILTER (y = 0 AND pr = 1) AS fp, count(*) FILTER (y = 1 AND pr = 0) AS fn FROM b GROUP BY task),
a AS (SELECT task, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc FROM (SELECT task, p FROM b WHERE y = 1) x JOIN (SELECT task, p FROM b WHERE y = 0) z USING (task) GROUP BY task)
SELECT task, n, round(CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE ok / v END, 6) AS accuracy, round(CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE coalesce(tp / nullif(tp + fp, 0), 0) END, 6) AS precision,
round(CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE coalesce(tp / nullif(tp + fn, 0), 0) END, 6) AS recall, round(CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END, 6) AS f1,
round(coalesce(auc, 'nan'::DOUBLE), 6) AS roc_auc, round(1 - v / n, 6) AS failure_rate FROM c LEFT JOIN a USING (task)"""


def _bleu(s, d):
    return _rounded(metrics.corpus_bleu(caption_pairs(s, d), ["task"]), "bleu")


def _gram_sql(n):
    return f"""g{n} AS (SELECT task, doc_id, sum(least(a, b)) AS m, sum(a) AS t, sum(b) AS r FROM (
      SELECT task, doc_id, g, count(*) FILTER (h) AS a, count(*) FILTER (NOT h) AS b FROM (
        SELECT task, doc_id, true AS h, array_to_string(hyp[i:i + {n - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(hyp) - {n - 2})) AS i FROM pairs)
        UNION ALL SELECT task, doc_id, false, array_to_string(ref[i:i + {n - 1}], ' ') FROM (SELECT *, unnest(range(1, len(ref) - {n - 2})) AS i FROM pairs)) GROUP BY task, doc_id, g) GROUP BY task, doc_id)"""


BLEU = f"""WITH {PAIRS}, {', '.join(_gram_sql(n) for n in (1, 2, 3, 4))}, c AS (SELECT task, sum(len(ref)) AS r, sum(len(hyp)) AS c FROM pairs GROUP BY task),
{', '.join(f's{n} AS (SELECT task, sum(m) AS m{n}, sum(t) AS t{n} FROM g{n} GROUP BY task)' for n in (1, 2, 3, 4))}
SELECT task, round(CASE WHEN coalesce(m1, 0) = 0 OR coalesce(m2, 0) = 0 OR coalesce(m3, 0) = 0 OR coalesce(m4, 0) = 0 THEN 0.0 ELSE
100 * exp(CASE WHEN c >= r THEN 0.0 ELSE 1 - r / c END + (ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) END, 6) AS bleu FROM c LEFT JOIN s1 USING (task) LEFT JOIN s2 USING (task) LEFT JOIN s3 USING (task) LEFT JOIN s4 USING (task)"""
ROUGE = f"WITH {PAIRS}, {_gram_sql(2)} SELECT task, round(100 * avg(coalesce(2 * m / nullif(t + r, 0), 0)), 6) AS rouge FROM pairs LEFT JOIN g2 USING (task, doc_id) GROUP BY task"


def _regressed(s, d):
    e = _events(s, d)
    label, said = F.col("value"), F.when(F.col("event_id") % 7 != 0, F.col("value") + F.col("user_id") % 5)
    return _rounded(metrics.regression(e, ["event_type"], label, said), "mae", "mse", "rmse", "failure_rate")


def _merged(s, d):
    e = _events(s, d)
    logs = e.select((F.col("user_id") - 1).alias("val_idx"), F.col("event_type").alias("strategy"), (F.col("event_id") % 6).alias("rank"), F.col("event_id").alias("line"))
    logs = logs.withColumn("val_idx", F.when(F.col("line") % 50 == 0, -1).otherwise(F.col("val_idx")))
    return history.merge_first(logs, ["val_idx", "strategy"], ["rank", "line"], "val_idx")


def _runs(s, d):
    return history.contiguous(_events(s, d), "user_id", "event_type", "event_id")


def _bits(s, d):
    v = load(s, "embeddings", d)
    coded = v.select("vec_id", "label", metrics.packed_signs(F.col("embedding")).alias("code"))
    first = coded.groupBy("label").agg(F.min_by("code", "vec_id").alias("c0"))
    both = coded.join(first, "label")
    return both.groupBy("label").agg(F.round(F.avg(metrics.tanimoto(F.col("code"), F.col("c0"))), 6).alias("tanimoto"), F.sum(metrics.hamming(F.col("code"), F.col("c0"))).alias("bits"))


BITS = """WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings), f AS (SELECT label, arg_min(code, vec_id) AS c0 FROM c GROUP BY label),
p AS (SELECT label, list_zip(code, c0) AS z FROM c JOIN f USING (label))
SELECT label, round(avg(len(list_filter(z, lambda x: x[1] AND x[2])) / nullif(len(list_filter(z, lambda x: x[1] OR x[2])), 0)), 6) AS tanimoto, CAST(sum(len(list_filter(z, lambda x: x[1] <> x[2]))) AS BIGINT) AS bits FROM p GROUP BY label"""

EDGES = [50.0, 100.0, 200.0, 400.0, 10000.0, 20000.0]
DAY = "CAST(epoch(ts) AS BIGINT) // 3600"

QUERIES: dict[str, Query] = {
    "cls_metrics": (_classified, CLASSIFIED),
    "reg_metrics": (
        _regressed,
        """SELECT event_type, count(*) AS n, round(coalesce(avg(g), 'inf'::DOUBLE), 6) AS mae, round(coalesce(avg(g * g), 'inf'::DOUBLE), 6) AS mse, round(coalesce(sqrt(avg(g * g)), 'inf'::DOUBLE), 6) AS rmse,
        round(count(*) FILTER (g IS NULL) / count(*), 6) AS failure_rate FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN abs(value - (value + user_id % 5)) END AS g FROM events) GROUP BY event_type""",
    ),
    "reg_metrics_empty_inf": (
        lambda s, d: metrics.regression(_events(s, d), ["event_type"], F.col("value"), F.lit(None).cast("double")).select("event_type", "mae", "failure_rate"),
        "SELECT event_type, 'inf'::DOUBLE AS mae, 1.0::DOUBLE AS failure_rate FROM events GROUP BY event_type",
    ),
    "corpus_bleu": (_bleu, BLEU),
    "rouge_n": (lambda s, d: _rounded(metrics.rouge_n(caption_pairs(s, d), ["task"], 2), "rouge"), ROUGE),
    "caption_scores": (lambda s, d: _rounded(texts.text_scores(caption_pairs(s, d), ["task"]), "bleu2", "bleu4", "rouge1", "rouge2", "rouge_l"), None),
    "meteor": (lambda s, d: caption_pairs(s, d).groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(texts.meteor(F.col("ref"), F.col("hyp"))), 6).alias("meteor")), None),
    "rouge_l": (lambda s, d: _rounded(metrics.rouge_l(caption_pairs(s, d), ["task"]), "rouge"), None),
    "gdr_grouping_sets": (
        lambda s, d: _rounded(metrics.preference(_events(s, d), "event_type", F.col("value"), F.lit(50.0)), "accuracy", "r_w", "r_l", "margin", to=4),
        "SELECT event_type, round(avg(CASE WHEN value - 50.0 > 0 THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(value), 4) AS r_w, round(avg(50.0::DOUBLE), 4) AS r_l, round(avg(value - 50.0), 4) AS margin, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
    ),
    "summary_stats": (
        lambda s, d: _rounded(metrics.summary(load(s, "orders", d), ["o_orderpriority"], "o_totalprice"), "mean", "std", "min", "p25", "median", "p75", "p90", "max", to=3),
        """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev_pop(o_totalprice), 3) AS std, round(min(o_totalprice), 3) AS min, round(quantile_cont(o_totalprice, 0.25), 3) AS p25, round(quantile_cont(o_totalprice, 0.5), 3) AS median,
        round(quantile_cont(o_totalprice, 0.75), 3) AS p75, round(quantile_cont(o_totalprice, 0.9), 3) AS p90, round(max(o_totalprice), 3) AS max FROM orders GROUP BY o_orderpriority""",
    ),
    "histogram_zero_bins": (
        lambda s, d: metrics.histogram(_events(s, d), F.col("value"), EDGES),
        """SELECT b.bin, b.lo, b.hi, count(e.value) AS n FROM (VALUES (0, NULL, 50.0::DOUBLE), (1, 50.0::DOUBLE, 100.0::DOUBLE), (2, 100.0::DOUBLE, 200.0::DOUBLE), (3, 200.0::DOUBLE, 400.0::DOUBLE), (4, 400.0::DOUBLE, 10000.0::DOUBLE), (5, 10000.0::DOUBLE, 20000.0::DOUBLE), (6, 20000.0::DOUBLE, NULL)) b(bin, lo, hi)
        LEFT JOIN events e ON (b.lo IS NULL OR e.value >= b.lo) AND (b.hi IS NULL OR e.value < b.hi) GROUP BY ALL""",
    ),
    "in_band_rate": (
        lambda s, d: load(s, "lineitem", d).groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_discount").between(0.04, 0.06).cast("int")), 6).alias("rate")),
        "SELECT l_returnflag, round(avg(CASE WHEN l_discount BETWEEN 0.04::DOUBLE AND 0.06::DOUBLE THEN 1 ELSE 0 END), 6) AS rate FROM lineitem GROUP BY l_returnflag",
    ),
    "tanimoto_bits": (_bits, BITS),
    "trial_variance": (
        lambda s, d: metrics.trial_variance(load(s, "lineitem", d), "l_suppkey", "l_linestatus", "l_quantity").select("l_linestatus", F.round("variance", 4).alias("variance")),
        "SELECT l_linestatus, round(avg(v), 4) AS variance FROM (SELECT l_suppkey, l_linestatus, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY l_linestatus",
    ),
    "merge_dedup_first": (
        _merged,
        """WITH l AS (SELECT CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id - 1 END AS val_idx, event_type AS strategy, event_id % 6 AS rank, event_id AS line FROM events)
        SELECT * FROM l QUALIFY val_idx < 0 OR row_number() OVER (PARTITION BY val_idx, strategy ORDER BY rank, line) = 1""",
    ),
    "nearest_step": (
        lambda s, d: history.nearest(_events(s, d).select("event_id", "value"), F.col("value"), 33.3, "event_id"),
        "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY abs(value - 33.3::DOUBLE), event_id LIMIT 1",
    ),
    "argmax_first": (
        lambda s, d: history.first_best(load(s, "orders", d), ["o_orderstatus"], F.col("o_totalprice"), "o_orderkey", ["o_orderkey", "o_totalprice"]),
        "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1",
    ),
    "first_match": (
        lambda s, d: history.first_match(load(s, "orders", d).select("o_orderkey", "o_orderpriority"), F.col("o_totalprice") > 100000, "o_orderkey"),
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 1",
    ),
    "ema_fold": (
        lambda s, d: history.moving_mean(_events(s, d), "event_type", ["ts", "event_id"], "value", 0.9).select("event_type", "n", F.round("ema", 4).alias("ema")),
        """SELECT event_type, any_value(n) AS n, round(sum(value * CASE WHEN k = 1 THEN 1.0 ELSE 0.1 END * pow(0.9::DOUBLE, n - k)), 4) AS ema FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""",
    ),
    "interval_flush": (
        lambda s, d: history.flushed_means(_events(s, d), ["event_type"], F.col("event_id"), 500, "value").withColumn("mean", F.round("mean", 4)),
        "SELECT event_type, event_id // 500 AS flush, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL",
    ),
    "contiguous_blocks": (
        _runs,
        """SELECT user_id, event_type, CAST(sum(s) AS BIGINT) AS runs, sum(s) = 1 AS contiguous FROM (SELECT user_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events) GROUP BY ALL""",
    ),
    "mask_ordinal": (
        lambda s, d: history.ordinal(_events(s, d), "user_id", "event_id", F.col("event_type") == "click").select("event_id", "ordinal"),
        """SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) END AS ordinal FROM events""",
    ),
    "top_k_per_row": (
        lambda s, d: history.top_k(load(s, "lineitem", d), "l_suppkey", "l_extendedprice", "l_orderkey", 3).select("l_suppkey", "l_orderkey", "l_extendedprice", "rank"),
        "SELECT l_suppkey, l_orderkey, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS rank FROM lineitem) WHERE rank <= 3",
    ),
    "history_pad": (
        lambda s, d: history.padded_history(_events(s, d).withColumn("epoch", F.col("event_id") % 40), "epoch", "event_id", "event_type", ["click", "view", "purchase"], "value"),
        "SELECT event_id % 40 AS epoch, coalesce(arg_max(value, event_id) FILTER (event_type = 'click'), 'nan'::DOUBLE) AS click, coalesce(arg_max(value, event_id) FILTER (event_type = 'view'), 'nan'::DOUBLE) AS view, coalesce(arg_max(value, event_id) FILTER (event_type = 'purchase'), 'nan'::DOUBLE) AS purchase FROM events GROUP BY 1",
    ),
    "count_max_two_level": (
        lambda s, d: _events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("most"), F.sum("n").alias("total")),
        "SELECT user_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id",
    ),
    "partial_metrics_all_tasks": (
        lambda s, d: s.createDataFrame([(t,) for t in ("en", "de", "fr", "es", "it")], "task string").join(scored(s, d).groupBy("task").agg(F.count("*").alias("n"), F.sum("y").alias("good")), "task", "left").na.fill(0, ["n", "good"]),
        f"WITH {SCORED} SELECT t.task, count(s.doc_id) AS n, CAST(coalesce(sum(s.y), 0) AS BIGINT) AS good FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) t(task) LEFT JOIN scored s USING (task) GROUP BY t.task",
    ),
}
