"""op9 against a scan of every string, with groups sorted in tasks and with passes alone."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import queries, repeats

from .helpers import SF, empty, odd, table


def expected(docs, length):
    data = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[p : p + length] for b in data.values() for p in range(len(b) - length + 1))
    for i, b in data.items():
        mask = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mask[p + 1 : p + 1 + length] = True
        edge = np.diff(mask.astype(int))
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        yield i, (len(b), runs, bytes(x for x, m in zip(b, mask[1:], strict=False) if not m))


def found(df, **options):
    return {r.doc: (r.n_bytes, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in repeats.remove_repeats(df, **options).collect()}


def test_whole_table(spark):
    docs = table("documents", "doc_id, text")
    assert found(spark.read.parquet(f"{SF}/documents.parquet")) == dict(expected(docs, 400))


@pytest.mark.parametrize("gathered", [0, 3, 512])
def test_both_ways(spark, gathered):
    rng = random.Random(gathered)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(10, 60))) for _ in range(9)]
    docs = [(i, "".join(rng.choice([*pool, "x", "yy", chr(233)]) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(98, "a" * 90), (99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, length=24, gram=12, gathered=gathered) == dict(expected(docs, 24))


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    rng = random.Random(8)
    data = bytes(rng.choice(b"abcd") for _ in range(700))
    whole = repeats.anchors(data, 24, 12)
    for p in range(len(data) - 24):
        window = repeats.anchors(data[p : p + 24], 24, 12)
        assert p + window[0] in whole


def test_edges(spark):
    rows = repeats.remove_repeats(odd(spark)).collect()
    assert sorted(r.doc or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 5, 6, 7]
    got = {r.doc: (r.n_bytes, r.removed, bytes(r.kept)) for r in rows}
    assert got[4][2] == got[6][2] == b"" and got[1] == (0, [], b"") and got[None][2] == b"one two" and got[5][2] == b"one"
    assert found(empty(spark)) == {}


def test_identical_rows_repeat_each_other(spark):
    text = "".join(random.Random(5).choice("abcdef") for _ in range(500))
    rows = spark.createDataFrame([(1, text), (1, text), (None, "x" + text), (2, None)], "doc_id long, text string")
    got = sorted((r.doc or 0, r.n_bytes, bytes(r.kept)) for r in repeats.remove_repeats(rows).collect())
    assert got == [(0, 501, b"x"), (1, 500, b""), (1, 500, b""), (2, 0, b"")]


def test_the_text_beside_its_digest(spark):
    got = queries.op9_suffix_array_dedup(spark, SF).collect()
    assert all(hashlib.sha256((r.kept_text or "").encode()).hexdigest() == r.kept_sha256 for r in got if "\ufffd" not in r.kept_text)
