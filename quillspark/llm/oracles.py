"""DuckDB SQL for operators whose plain definition SQL can express, if not at scale."""

OP3_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b)
SELECT r.a AS doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
"""

OP6_SQL = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(range(1, n - 98), lambda i: {'i': i, 'h': hash(b[i : i + 99])})) AS s FROM docs WHERE n >= 100),
ranked AS (SELECT doc_id, s.i AS i, row_number() OVER (PARTITION BY s.h ORDER BY doc_id, s.i) AS nth FROM starts),
later AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM ranked WHERE nth > 1),
islands AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM later),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM islands GROUP BY doc_id, run),
cuts AS (SELECT doc_id, hi AS since, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS upto FROM (SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, 0, 1 FROM docs)),
kept AS (
  SELECT c.doc_id, string_agg(CASE WHEN coalesce(c.upto, d.n + 1) > c.since THEN hex(d.b[c.since : coalesce(c.upto, d.n + 1) - 1]) ELSE '' END, '' ORDER BY c.since) AS body
  FROM cuts c JOIN docs d ON d.doc_id = c.doc_id GROUP BY c.doc_id),
gone AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.n_spans, 0) AS n_spans, sha256(unhex(k.body)) AS kept_sha256
FROM docs d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""
