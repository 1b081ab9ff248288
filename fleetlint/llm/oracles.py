"""DuckDB SQL of the operators that SQL can express on whole (small) tables.

Not here: secret scan and PII (look-behind patterns, iterated scores), search,
language model, classifiers; their tests compare with brute force or held-out
rows.
"""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_UP}', '{_LOW}')"


JOIN = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS s FROM w) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, ee.y FROM r JOIN ee ON ee.x = r.reach),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PASSAGES = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_WORDS}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_folded('text')}, '{_WORDS}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS s
       FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0) x),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS s
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks) x),
occ AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON bw.k = dw.k AND bw.s = dw.s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM occ),
runs AS (SELECT doc_id, count(*) AS n_hit, count(*) FILTER (WHERE p IS NULL OR p < i - 1) AS n_spans
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit) x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) x GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(runs.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(runs.n_hit, 0) > 0 AS contaminated, coalesce(runs.n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""

REPEATS = """
WITH
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
ck AS (SELECT doc_id, j, n, substr(x, 2000 * j + 1, 2098) AS x
       FROM (SELECT doc_id, x, length(x) // 2 AS n, unnest(range(0, (length(x) // 2 + 999) // 1000)) AS j FROM h) y),
bt AS (SELECT doc_id, j, n, x, unnest(range(1, least(1000, n - 1000 * j) + 1)) AS k FROM ck),
ws AS (SELECT doc_id, 1000 * j + k AS i, CASE WHEN 1000 * j + k + 49 <= n THEN substr(x, 2 * k - 1, 100) END AS s, substr(x, 2 * k - 1, 2) AS c FROM bt),
firsts AS (SELECT s, min(doc_id) AS low FROM ws WHERE s IS NOT NULL GROUP BY s),
marked AS (SELECT ws.doc_id, ws.i, ws.c, CASE WHEN f.low < ws.doc_id THEN 1 END AS rem FROM ws LEFT JOIN firsts f ON f.s = ws.s),
gone AS (SELECT doc_id, i, c, max(rem) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS g FROM marked),
edge AS (SELECT *, lag(g) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone),
kept AS (SELECT doc_id, count(g) AS n_removed, count(*) FILTER (WHERE g = 1 AND p IS NULL) AS n_spans,
                string_agg(CASE WHEN g IS NULL THEN c END, '' ORDER BY i) AS k FROM edge GROUP BY doc_id)
SELECT h.doc_id, (length(h.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)"""
