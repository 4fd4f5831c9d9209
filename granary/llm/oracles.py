"""SQL for the queries that SQL can state, run by DuckDB on the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
asked AS (SELECT DISTINCT item, array_to_string(w[s:s + k - 1], ' ') AS g, k FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM asked),
placed AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, k, item FROM placed JOIN asked USING (g, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP2 = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + 2 * length(role) + 14) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM v
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) x ON x.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) y ON y.a = vec_id"""

OP11 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER w <= 5"""

OP13 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, CAST('0x' || substr(md5('13,' || coalesce(CAST(doc_id AS VARCHAR), '') || ',' || size), 1, 15) AS BIGINT) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM k GROUP BY source),
f AS (SELECT *, sum(z) OVER () AS t, sum(w) OVER () AS ws, 3 * (w * sum(z) OVER o + z * (sum(w) OVER () - sum(w) OVER o)) < w * sum(z) OVER () AS is_full FROM s WINDOW o AS (ORDER BY CAST(z AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT source, z, CASE WHEN is_full THEN 3.0 * CAST(z AS DOUBLE) ELSE least(CAST(t - 3 * coalesce(sum(z) FILTER (is_full) OVER (), 0) AS DOUBLE) * w / CAST(ws - coalesce(sum(w) FILTER (is_full) OVER (), 0) AS DOUBLE), 3.0 * CAST(z AS DOUBLE)) END AS target FROM f),
p AS (SELECT source, z, target, CASE WHEN z > 0 THEN CAST(floor(target) AS BIGINT) // z ELSE 0 END AS epochs, CAST(floor(target) AS BIGINT) AS budget FROM g)
SELECT doc_id, size, z AS source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + greatest(0, least(size, budget - epochs * z - (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source"""



def _op12(rounds: int = 2) -> str:
    """Lloyd's rounds with every distance measured."""
    near = "{a} AS (SELECT rid, part, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (SELECT x.rid, x.part, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) AS d FROM x JOIN {b} b USING (part)) GROUP BY rid, part)"
    moved = "{c} AS (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM {b} b LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS v FROM (SELECT x.part, a.e, i, CAST(floor(CAST(sum(x.v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM x JOIN {a} a USING (rid, part), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM x))) AS i) GROUP BY x.part, a.e, i) GROUP BY part, e) m ON b.part = m.part AND b.e = m.e)"
    steps = []
    for k in range(rounds):
        steps += [near.format(a=f"a{k}", b=f"b{k}"), moved.format(a=f"a{k}", b=f"b{k}", c=f"b{k + 1}")]
    steps.append(near.format(a="fin", b=f"b{rounds}"))
    return f"""WITH good AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS w FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT rid, p AS part, list_slice(w, p * (len(w) // 16) + 1, (p + 1) * (len(w) // 16)) AS v FROM good, range(16) r(p)),
b0 AS (SELECT part, rid - 1 AS e, v FROM x WHERE rid <= 64),
{", ".join(steps)},
told AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM fin GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM told JOIN good USING (rid), book"""


ORACLES = {"op1_benchmark_decontamination": OP1, "op2_chat_formatting": OP2, "op5_embedding_near_dedup": OP5, "op11_hard_negatives": OP11, "op12_vector_codes": _op12(), "op13_source_mixing": OP13}
