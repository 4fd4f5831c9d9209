"""op5 against all pairs: recall and precision are 1."""

from __future__ import annotations

import numpy as np

from granary.llm import neighbours, queries

from .helpers import SF, Sets, table


def expected(rows):
    fine = [(i, lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    links, sets = {i: 0 for i, _, _ in rows}, Sets([i for i, _, _ in rows])
    for a, (i, la, x) in enumerate(fine):
        for j, lb, y in fine[a + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    return {i: (links[i], sets.find(i)) for i in links}


def test_whole_table(spark):
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op5_embedding_near_dedup(spark, SF).collect()}
    assert got == expected(table("embeddings", "vec_id, embedding, label"))


def test_clusters_and_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.12).astype(np.float32).tolist(), int(i % 2)) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] * 8, 1), (404, rows[0][1], None), (405, [1.0], 1), (406, [2.0], 1), (407, [], 1)]
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n int")
    got = {r.id: (r.n_links, r.component) for r in neighbours.link_vectors(df, reach=1.0, codes=4).collect()}
    assert got == expected(rows)
    assert neighbours.link_vectors(df.limit(0)).count() == 0


def test_recall_at_the_default_reach(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 64))
    rows = [(i, (centres[i % 150] + rng.normal(size=64) * 0.1).astype(np.float32).tolist(), 1) for i in range(900)]
    got = {r.id: r.n_links for r in neighbours.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), codes=12).collect()}
    wanted = expected(rows)
    assert all(got[i] <= wanted[i][0] for i in got)
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in wanted.values()) > 0


def test_bounds_never_lose_a_cell():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book, _ = neighbours.fit_codebooks(x, 8)
    near, h = neighbours.half_bounds(x[:, :3], book)
    for i in range(0, 400, 7):
        gap = ((x[:, :3] - x[i, :3]) ** 2).sum(1)
        assert (h[i][near] <= gap + 1e-9).all()


def test_doubles_and_labels_of_any_type(spark):
    rows = [(1, [1e300, 1e300], "a"), (2, [2e300, 2e300], "a"), (3, [1e-300, 1.1e-300], "a"), (4, [1.0, 1.0], "b"), (5, [1.0, 1.0], "b"), (6, [1.0, -1.0], "b"), (7, [0.0, 0.0], "b"), (None, [1.0, 1.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.id: (r.n_links, r.component) for r in neighbours.link_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (2, 4), 5: (2, 4), 6: (0, 6), 7: (0, 7), None: (2, 4)}


def test_repeated_rows_are_vectors_of_their_own(spark):
    df = spark.createDataFrame([(9, [1.0, 2.0], 1)] * 3, "vec_id long, embedding array<float>, label int")
    assert [(r.id, r.n_links, r.component) for r in neighbours.link_vectors(df).collect()] == [(9, 2, 9)] * 3
