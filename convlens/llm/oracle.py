"""What SQL can say of the operators: the same results, for small tables, in DuckDB."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS mass,
             sum(source_size) OVER fill AS before, sum(weight) OVER fill AS weight_before
      FROM w WINDOW fill AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - 3 * coalesce(before, 0) AS DOUBLE) / CAST(mass - coalesce(weight_before, 0) AS DOUBLE) AS level FROM f),
m AS (SELECT *, max(CASE WHEN level * weight >= 3 * source_size THEN NULL ELSE level END) OVER () AS stop FROM l),
t AS (SELECT source, source_size, CASE WHEN stop IS NULL THEN CAST(3 * source_size AS DOUBLE)
             ELSE least(CAST(3 * source_size AS DOUBLE), stop * weight) END AS target FROM m),
r AS (SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             (CAST(CAST('0x' || substr(md5('mix-1' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
               / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part, target - floor(rate) * source_size AS need FROM r),
o AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part) * 1.0) END AS rank FROM p),
c AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank / (1 + rank) NULLS LAST, doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
SELECT doc_id, size, source_size, target,
       CAST(size * CASE WHEN size = 0 THEN 0
                        ELSE whole + CASE WHEN rank IS NOT NULL AND need > 0 AND upto - size / 2 <= need THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM c"""

JACCARD = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
      FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingles FROM d),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = doc_id GROUP BY doc_id, n"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE = {"op5_mix_sources": MIX, "op10_jaccard_join": JACCARD, "op13_maxscore": TOPK}
