"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import corpus_pipeline
from granary.llm import toxicity
from granary.llm.common import stored

from .helpers import SF
from .test_decontam import expected as contaminated
from .test_lines import expected as deduplicated
from .test_simhash import Sets, fingerprint


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
            assert after == {i: t for i, t in before.items() if toxicity.score_text(model, t)[0] < corpus_pipeline.TOXIC}
        elif name == "line_dedup":
            wanted = deduplicated(list(before.items()))
            assert after == {i: t for i, t in wanted.items() if t.strip() or t == before[i]}
        elif name == "simhash_near_dedup":
            prints, sets = {i: fingerprint(t) for i, t in before.items()}, Sets(before)
            for i in before:
                for j in before:
                    if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                        sets.join(i, j)
            assert after == {i: t for i, t in before.items() if sets.find(i) == i}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, told in contaminated(list(before.items()), items) if told[-1]}
            assert after == {i: t for i, t in before.items() if i not in bad}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]


def test_null_ids_and_empty_tables_pass(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [(None, "clean words here", "en", "s", 16), (1, None, "en", None, None), (2, "", None, "s", 0)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs, n in ((some, 2), (some.limit(0), 0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert len(got) == n


def test_clashing_columns_and_empty_side_tables(spark, tmp_path):
    """Documents with columns of the names that stages use inside; no labels, no benchmark items; identical rows of one id."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    same = "a line of some words that is said again and again and again"
    rows = [(1, f"{same}\nown one", 1), (2, f"{same}\nanother thing", 2), (3, "x", 3), (3, "x", 3), (4, " ".join(f"w{k}" for k in range(40_000)), 4), (5, None, 5)]
    names = ["score", "lines_read", "lines_removed", "doc", "gone", "row", "label", "component", "fp", "term"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[k] * len(names)) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[-len(names) :] == names
    got = sorted((r.doc_id, r.text, r.n_chars, r.score) for r in docs.collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4] or [g[0] for g in got] == [1, 2, 3, 3, 4, 5]
    assert got[0][1:] == (f"{same}\nown one", len(f"{same}\nown one"), 1) and got[1][1:] == ("another thing", len("another thing"), 2)
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == {g[0] for g in got}
