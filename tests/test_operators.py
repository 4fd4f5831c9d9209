"""Operators on small inputs: nulls, ties, quirks and policies."""

from __future__ import annotations

import math
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import audit, decontam, evaluation, history, metrics, sampling, texts, training
from granary.sources import sinks, tables
from granary.streaming import logs


def rows(spark, *values):
    return spark.createDataFrame(list(values), "doc_id long, task string, split string, key string")


def test_leakage_keeps_null_keys_and_train_duplicates(spark):
    df = rows(spark, (1, "a", "train", "x"), (2, "a", "train", None), (3, "a", "train", "y"), (4, "a", "train", "y"), (5, "a", "test", "x"), (6, "a", "val", None), (7, "b", "train", "x"))
    kept = {r.doc_id for r in decontam.remove_leakage(df, "task").collect()}
    assert kept == {2, 3, 4, 7}
    again = decontam.flag_leakage(df, "task").where("leaked").collect()
    assert [r.doc_id for r in again] == [1]


def test_family_duplicates_leave_the_anchor(spark):
    df = rows(spark, (1, "a", "train", "x"), (2, "b", "train", "x"), (3, "b", "train", None), (4, "b", "test", "x"), (5, "c", "train", "x"))
    family = F.when(F.col("task").isin("a", "b"), "f")
    out = decontam.flag_family_duplicates(df, family, F.col("task") == "b")
    assert [r.doc_id for r in out.where("duplicated").collect()] == [2]


@pytest.mark.parametrize(("n", "wanted"), [(3297, 33), (100, 10), (11, 10), (9, 9), (2500, 25), (3500, 35), (1250, 12), (1350, 14)])
def test_stratified_rounds_half_to_even(spark, n, wanted):
    assert sampling.stratified(spark.range(n).withColumn("t", F.lit("a")), "t", 100, 10, "id").count() == wanted


def test_replicate_and_pairing(spark):
    df = spark.range(5).withColumn("g", F.lit(1))
    out = sampling.replicate(df, 10, F.array(F.lit("x"), F.lit("y")), "id")
    assert out.count() == 50 and {r.template for r in out.collect()} == {"x", "y"}
    pairs = sampling.paired(df.union(spark.createDataFrame([(9, 2)], "id long, g int")), "g", "id").collect()
    assert sorted(p.partner for p in pairs) == [0, 1, 2, 3, 4] and all(p.id != p.partner for p in pairs)


def test_tags(spark):
    texts = ["<BOOLEAN> True, False </BOOLEAN>", "<BOOLEAN>no</BOOLEAN>", "<BOOLEAN> true", None, "<FLOAT> <|+|><|1|><|.|><|5|> </FLOAT>", "<FLOAT>\n2 </FLOAT>", "<FLOAT> x </FLOAT>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", T.boolean_tag(F.col("t")).alias("b"), T.float_tag(F.col("t")).alias("f"), T.tag_content_open(F.col("t"), "BOOLEAN").alias("o")).orderBy("i").collect()
    assert [r.b for r in got] == [True, None, None, None, None, None, None]
    assert [r.f for r in got] == [None] * 4 + [1.5, 2.0, None]
    assert got[2].o == " true" and got[3].o is None
    wrapped = spark.range(1).select(T.wrap_float(F.lit(-1234.56789)).alias("a"), T.wrap_float(F.lit(0.5)).alias("b")).first()
    assert wrapped.a == "<FLOAT> " + "".join(f"<|{c}|>" for c in "-1234.5") + " </FLOAT>" and wrapped.b.startswith("<FLOAT> <|+|><|0|><|.|>")


def test_component_keys(spark):
    df = spark.createDataFrame([("b.a>>c",), ("a.b>>c",), ("a..b>>c",), (None,)], "t string")
    got = [r[0] for r in df.select(T.component_key(F.col("t"))).collect()]
    assert got == ["a.b>>c"] * 3 + [None]
    failing = df.select(T.component_key(F.col("t"), canonical=lambda p: F.when(p != "c", p))).collect()
    assert all(r[0] is None for r in failing)


def test_retag_is_strict(spark):
    df = spark.createDataFrame([("x <SMILES>ab</SMILES> y <SMILES> <None> </SMILES>",), ("plain",)], "t string")
    got = [r[0] for r in df.select(T.retag(F.col("t"), "SMILES", "SELFIES", F.upper)).collect()]
    assert got == ["x <SELFIES> AB </SELFIES> y <SELFIES> <None> </SELFIES>", "plain"]
    lost = df.select(T.retag(F.col("t"), "SMILES", "SELFIES", lambda c: F.lit(None).cast("string"))).collect()
    assert [r[0] for r in lost] == [None, "plain"]


def test_classification_edges(spark):
    df = spark.createDataFrame([("one", 1, 0.9), ("one", 1, 0.2), ("none", None, 0.5), ("two", 1, 0.8), ("two", 0, 0.8), ("two", 0, 0.1)], "t string, y int, p double")
    got = {r.t: r for r in metrics.classification(df, ["t"], F.col("y"), 1 - F.col("p"), F.col("p")).collect()}
    assert math.isnan(got["one"].roc_auc) and got["one"].accuracy == 0.5
    assert math.isnan(got["none"].accuracy) and got["none"].failure_rate == 1
    assert got["two"].roc_auc == 0.75


def test_regression_without_valid_rows_is_infinite(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 3.0)], "t string, y double, p double")
    got = {r.t: r for r in metrics.regression(df, ["t"], F.col("y"), F.col("p")).collect()}
    assert got["a"].mae == math.inf and got["a"].failure_rate == 1 and got["b"].rmse == 2


def test_preference_means(spark):
    df = spark.createDataFrame([("A", 1.0, 0.0), ("A", 2.0, 1.0), ("A", 0.0, 1.0), ("B", 1.0, 0.5)], "t string, w double, l double")
    got = {r.t: r for r in metrics.preference(df, "t", F.col("w"), F.col("l")).collect()}
    assert got["A"].accuracy == pytest.approx(2 / 3) and got["B"].accuracy == 1 and got[None].accuracy == 0.75 and got[None].n == 4


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6)), min_size=1, max_size=6))
def test_longest_common_subsequence(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [texts.common_subsequence(r.a, r.b) for r in df.orderBy("i").collect()]
    assert got == [lcs(a, b) for a, b in pairs]


def test_merge_keeps_rows_without_identity(spark):
    df = spark.createDataFrame([(1, "s", 0, 0), (1, "s", 1, 1), (-1, "s", 0, 2), (-1, "s", 0, 3), (2, "s", 1, 4)], "v int, s string, rank int, line int")
    assert history.merge_first(df, ["v", "s"], ["rank", "line"], "v").count() == 4


def test_moving_mean_is_the_fold(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "t string, o int, x double")
    ema = values[0]
    for v in values[1:]:
        ema = 0.9 * ema + 0.1 * v
    assert history.moving_mean(df, "t", ["o"], "x", 0.9).first().ema == pytest.approx(ema)


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 4.0, "a"), (2, 6.0, "a"), (3, None, "a"), (4, 6.0, "a")], "i int, x double, g string")
    assert history.nearest(df, F.col("x"), 5.0, "i").first().i == 1
    assert history.first_best(df, ["g"], F.col("x"), "i", ["i", "x"]).first().i == 2


def test_mask_always_hits_once(spark):
    df = spark.range(50).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    out = training.mask_tokens(df, "row", "pos", F.lit(0.0)).groupBy("row").agg(F.count_if("masked").alias("n")).collect()
    assert all(r.n == 1 for r in out)
    edges = spark.createDataFrame([(0.2,), (0.2001,), (1.0,)], "x double").select(training.mask_bucket(F.col("x"))).collect()
    assert [r[0] for r in edges] == [0, 1, 4]


def test_validation_counts_and_examples(spark):
    out = {r.category: r for r in audit.validate(spark.range(30), {"small": F.col("id") < 10, "fine": F.lit(True)}, "id", 3).collect()}
    assert out["small"].errors == 20 and out["small"].examples == "10,11,12" and out["fine"].errors == 0


def test_sources_and_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    assert sinks.write_once(spark.range(3), at) and not sinks.write_once(spark.range(9), at)
    assert spark.read.parquet(at).count() == 3
    sinks.replace(spark.range(5), at)
    assert spark.read.parquet(at).count() == 5
    assert tables.first_existing(spark, str(tmp_path / "no"), at) == at
    spark.range(2).write.option("header", True).csv(str(tmp_path / "c"))
    assert tables.load_or_csv(spark, str(tmp_path / "missing"), str(tmp_path / "c"), "id long").count() == 2
    with pytest.raises(ValueError, match="b"):
        tables.require(["a"], ["a", "b"])


def test_streams_agree_with_batch(spark, tmp_path):
    src, schema = str(tmp_path / "log"), "v long, s string, ts timestamp, x double"
    base = spark.range(40).select((F.col("id") % 10 - 1).alias("v"), F.lit("s").alias("s"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").cast("double").alias("x"))
    base.coalesce(1).write.json(src)
    once = logs.deduplicated(logs.log_stream(spark, src, schema), ["v", "s"], "ts", "1 hour", "v")
    logs.append_once(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("v >= 0").count() == 9 and got.where("v < 0").count() == 4
    q = logs.moving_means(logs.log_stream(spark, src, schema), "s", "ts", "x", 0.9).writeStream.outputMode("update").format("memory").queryName("ema").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = history.moving_mean(base, "s", ["ts"], "x", 0.9).first()
    last = spark.sql("SELECT * FROM ema ORDER BY n DESC").first()
    assert (last.n, last.ema) == (40, pytest.approx(batch.ema))


def test_replacement_keeps_both_tables_until_it_is_done(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace(spark.range(3), at)
    sinks.replace(spark.range(5), at)
    assert spark.read.parquet(at).count() == 5 and not sinks.exists(spark, f"{at}.old") and not sinks.exists(spark, f"{at}.new")
    spark.range(7).write.parquet(f"{at}.new")  # broke off before the moves
    sinks.recover(spark, at)
    assert spark.read.parquet(at).count() == 7
    sinks._move(spark, at, f"{at}.old")  # broke off between the moves, the new table not committed
    sinks.recover(spark, at)
    assert spark.read.parquet(at).count() == 7


def test_sources_and_contracts_fail_by_name(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown source: nothing"):
        tables.load(spark, "nothing", str(tmp_path))
    with pytest.raises(ValueError, match="missing tables: b"):
        tables.require(["a"], ["a", "b"])
    spark.range(2).write.parquet(str(tmp_path / "there"))
    assert tables.first_existing(spark, str(tmp_path / "missing"), str(tmp_path / "there")).endswith("there")
    assert tables.shard_rows(spark, str(tmp_path / "there")) == 2 and tables.shard_rows(spark, str(tmp_path / "missing")) is None
    assert tables.subtask_counts(spark, str(tmp_path)).count() == 0


def test_steps_and_reports():
    assert evaluation.check_steps(128, 32, 64) == 16
    for length, block, steps in ((16, 32, 8), (128, 32, 6)):
        with pytest.raises(ValueError):
            evaluation.check_steps(length, block, steps)


def test_pairs_that_must_be_there(spark):
    rows = spark.createDataFrame([(1, [1], [2], None)], "id int, p array<int>, c array<int>, r array<int>")
    slots, counts = evaluation.paired_slots(rows, F.col("p"), F.col("c"), F.col("r"), 4, 0)
    assert slots.count() == 0 and [tuple(r) for r in counts.collect()] == [("no pair", 1)]
    with pytest.raises(Exception, match="no pair"):
        evaluation.paired_slots(rows, F.col("p"), F.col("c"), F.col("r"), 4, 0, require=True)[0].collect()
    with pytest.raises(ValueError, match="report"):
        sinks.markdown(spark.range(5), most=4)


def test_samples_of_null_groups(spark):
    df = spark.createDataFrame([(None, k) for k in range(9)] + [("a", 20)], "g string, k int")
    assert sampling.per_group(df, "g", F.lit(4), "k").groupBy("g").count().orderBy("g").collect()[0]["count"] == 4
    pairs = {(r.k, r.partner) for r in sampling.paired(df, "g", "k").collect()}
    assert len(pairs) == 9 and {a for a, _ in pairs} == {b for _, b in pairs} == set(range(9))


def test_containment_of_long_texts(spark):
    """Windows of a text are hashed one by one, not compared with each other: 150,000 words took minutes."""
    words = [f"w{i}" for i in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b c " * 3 + "w7"), (3, None), (4, ""), (4, "w7 w8"), (5, "x w5 w6 w7 w8 w9 w10 w11 w12")], "id long, text string")
    items = spark.createDataFrame([(10, " ".join(words[140_000:140_020])), (11, "w7 w8"), (12, "no " * 9), (13, "y " + " ".join(words[5:13])), (14, "a b c a b c a b c"), (15, None)], "item_id long, text string")
    start = time.monotonic()
    got = {r.item_id: r.n_docs for r in decontam.containment(docs, items).collect()}
    assert got == {10: 1, 11: 3, 13: 2, 14: 1}
    assert time.monotonic() - start < 60
