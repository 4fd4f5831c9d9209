"""op10: ids against the tokenizers library, exact cover, fill, and shortest-pack-first."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granary.llm import packing, queries

from .helpers import SF, empty, odd, table


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a  b", "a \n b\n\nc", "it's we'll  x's", "Ünï 東京  \u2003x", "<|endoftext|> ok", "a<|endoftext|>", "<|endoftext|><|endoftext|> b  c", "x <|endoftext|> y<|end", "<|ENDOFTEXT|>", "a\x1c b", "tail ", "\ta b", "x 1234 56a_b"])
def test_ids(reference, text):
    assert np.frombuffer(packing.encoder()(text), "<u4").tolist() == reference(text)


def test_new_words_are_encoded_in_one_call(reference, monkeypatch):
    """A text's unknown words take one call (before: one each), and words that were dropped from memory come out the same."""
    rng = random.Random(3)
    new = ["".join(rng.choice("abcdeé東'.1\n<|") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    text = " ".join(["first", *(w for w in new if w == w.strip()), *(w for w in new[:50] if w == w.strip())])
    calls = []
    made = packing.tiktoken_encoding
    monkeypatch.setattr(packing, "tiktoken_encoding", lambda *a: lambda t, f=made(*a): calls.append(t) or f(t))
    for most in (packing.REMEMBERED, 30):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        encode = packing.encoder.__wrapped__()
        for k in range(3):
            calls.clear()
            said = " ".join(text.split(" ")[20 * k :])
            assert np.frombuffer(encode(said), "<u4").tolist() == reference(said)
            assert len(calls) <= 2
    assert encode("a\n b") == np.array(reference("a\n b"), "<u4").tobytes()


def check(rows, capacity=2048):
    for _, own in groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_whole_table(spark, reference):
    rows = queries.op10_packing(spark, SF).collect()
    check(rows)
    ids = {i: np.array([*reference(t or ""), 1], "<u4") for i, t in table("documents", "doc_id, text")}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}


def test_patterns_hold_every_piece():
    rng = random.Random(2)
    for _ in range(50):
        histogram = dict(Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 300))))
        packed = packing.patterns(histogram, 64)
        used = Counter()
        for pattern, packs in packed:
            assert packs > 0 and sum(k * n for k, n in pattern.items()) <= 64
            for k, n in pattern.items():
                used[k] += n * packs
        assert used == histogram


def test_edges(spark):
    rows = packing.pack_documents(odd(spark), capacity=16, with_ids=True).collect()
    check(rows, 16)
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.length for r in rows if r.doc_id == 1] == [1] and all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(empty(spark)).count() == 0
