"""op6 against all pairs, the trie against all pairs, and components against union-find."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from granary.llm import components, queries, simhash

from .helpers import SF, Sets, empty, odd, table


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_whole_table(spark):
    docs = {i: fingerprint(t) for i, t in table("documents", "doc_id, text")}
    sets = Sets(docs)
    ids = sorted(docs)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (docs[i] ^ docs[j]).bit_count() <= 4:
                sets.join(i, j)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{docs[i]:016x}", sets.find(i)) for i in docs}


def test_trie_links_span_all_classes():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = []
    for _ in range(700):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fp, group = np.array(fps, np.uint64), np.array([rng.randrange(3) for _ in fps])
    wanted, got = Sets(range(700)), Sets(range(700))
    for i in range(700):
        for j in range(i):
            if group[i] == group[j] and (fps[i] ^ fps[j]).bit_count() <= 4:
                wanted.join(i, j)
    for a, b in zip(*simhash.trie_links(group, fp, 4, small=2), strict=True):
        got.join(int(a), int(b))
    assert [got.find(i) for i in range(700)] == [wanted.find(i) for i in range(700)]


def test_split_blocks_lose_nothing(spark):
    rng = random.Random(5)
    core = rng.getrandbits(64)
    fps = sorted({core ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")
    wanted, got = Sets(range(len(fps))), Sets(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                wanted.join(i, j)
    for r in simhash.trie_join(df, 4, split_at=5).collect():
        got.join(r.u, r.v)
    assert [got.find(i) for i in range(len(fps))] == [wanted.find(i) for i in range(len(fps))]


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(25)] + [(500, x) for x in range(501, 560)] + [(None, 1), (7, 7)]
    sets = Sets(range(600))
    for a, b in links:
        if a is not None:
            sets.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: sets.find(i) for a, b in links if a is not None and a != b for i in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    by = {r.id: r.component for r in got}
    assert len(got) == 9 and by[1] == by[2] == by[3] == 1 and by[4] == by[6] == 4 and by[5] == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    rows = [(1, 0x0), (None, 0xF), (2, 0xFF), (None, 0xF), (9, 0x7FFF0000FFFF0000), (None, 0x5555555555555555)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "id long, fp long")).collect()
    assert sorted((r.fp, r.component) for r in found if r.fp < 0x100) == [(0x0, 1), (0xF, 1), (0xF, 1), (0xFF, 1)]
    assert {r.fp: r.component for r in found if r.fp > 0x100} == {0x7FFF0000FFFF0000: 9, 0x5555555555555555: None}
