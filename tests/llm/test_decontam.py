"""op1 against a scan of every window, and its edge cases."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from granary.llm import decontam, queries

from .helpers import SF, empty, odd, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, seen = words(text), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if found := windows.get(tuple(w[s : s + k])):
                    seen |= found
                    hit |= set(range(s, s + k))
        yield doc, (len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))


def test_whole_tables(spark):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op1_benchmark_decontamination(spark, SF).collect()}
    assert got == dict(expected(table("documents", "doc_id, text"), table("benchmark")))


def test_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "ONE"), (4, "one"), (None, "w1"), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (6, "zz zz")], "item_id long, text string")
    rows = decontam.contamination(odd(spark), items).collect()
    got = {r.doc_id: r for r in rows}
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 5, 6, 7] and got[None].n_words == 2
    assert got[5].item_ids == ["3", "4"] and got[5].n_words == 1 and got[5].contaminated
    assert got[1].n_words == 0 and got[3].n_words == 0 and not got[2].contaminated
    assert got[4].item_ids == ["5"] and got[4].n_hit == 14 * 31 and got[4].n_words == 30_000
    assert decontam.contamination(empty(spark), items).count() == 0
    assert decontam.contamination(odd(spark), items.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a x x x x x x x g"), (3, "g a")], "doc_id long, text string")
    index = decontam.build_index(docs)
    asked = decontam.item_words(spark.createDataFrame([(9, "g a")], "item_id long, text string"))
    near = lambda k: {r.doc_id for r in decontam.proximity_matches(index, asked, k).collect()}
    assert near(1) == {3} and near(6) == {1, 3} and near(8) == {1, 2, 3}
    assert {r.doc_id for r in index.where(F.col("term").isNull()).collect()} == {1, 2, 3}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    passage = [f"w{k}" for k in range(13)]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    halves = [" ".join(passage[:6] + ["x"] * 7), " ".join(["x"] * 6 + passage[6:])]
    docs = spark.createDataFrame([(1, halves[0]), (1, halves[1]), (2, " ".join(passage)), (2, " ".join(passage)), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, items).collect())
    assert got == [(1, 13, 0, False), (1, 13, 0, False), (2, 0, 0, False), (2, 13, 13, True), (2, 13, 13, True)]
