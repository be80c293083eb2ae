"""DuckDB SQL for the operators that SQL can express."""

#: Words [^\x20\x09-\x0D]+ of the text with A-Z lower-cased, five-word shingles, links at 3/4, smallest id reached.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
f AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS fp, sh FROM s),
r AS (SELECT fp, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM f WHERE n > 0 GROUP BY fp),
t AS (SELECT rep, n, unnest(sh) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(node, root) AS (SELECT rep, rep FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_shingles, coalesce(m.root, f.doc_id) AS component_id
FROM f LEFT JOIN r ON r.fp = f.fp AND f.n > 0 LEFT JOIN m ON m.node = r.rep
"""

#: Words of ASCII letters, digits and all beyond ASCII, lower-cased; windows of 13 words (a shorter item is one).
DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(ws), 13) AS k, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM bw),
dp AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k),
dw AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g FROM dp),
h AS (SELECT dw.doc_id, dw.k, dw.p, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
hw AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS p FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

#: Components floored to multiples of 1/64; the 20 best others of each row whose id 20 divides.
EXACT_TOPK = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: The list's entries by rule, their intervals, and the captures that fall into one.
URL_FILTER = r"""
WITH p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS INTEGER) % 366 AS day FROM pages),
h AS (SELECT host, d, e, array_to_string(string_split(host, '.')[-3:], '.') AS above FROM (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS d, CAST('0x' || substr(md5(host), 9, 6) AS INTEGER) AS e FROM p WHERE host IS NOT NULL)),
en AS (SELECT 'spam' AS list, 'host' AS kind, host AS pattern, 'add' AS action, d % 200 AS day FROM h WHERE d % 4 = 0
  UNION ALL SELECT 'spam', 'host', host, 'remove', d % 200 + e % 150 FROM h WHERE d % 8 = 0
  UNION ALL SELECT 'spam', 'host', host, 'add', d % 200 + e % 150 + 20 FROM h WHERE d % 16 = 0
  UNION ALL SELECT 'adult', 'domain', above, 'add', e % 300 FROM h WHERE e % 9 = 0
  UNION ALL SELECT 'adult', 'domain', above, 'remove', e % 300 + 40 FROM h WHERE e % 18 = 0
  UNION ALL SELECT 'legal', 'prefix', host || '/fr', 'add', e % 100 FROM h WHERE d % 3 = 0),
o AS (SELECT list, kind, pattern, day, max(action) AS action FROM en GROUP BY ALL),
c AS (SELECT *, lag(action) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS before FROM o),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM c WHERE before IS NULL OR before <> action),
m AS (SELECT DISTINCT p.page_id, p.url, i.list || ':' || i.kind || ':' || i.pattern AS rule FROM p JOIN i ON i.action = 'add' AND i.day <= p.day AND (i.until IS NULL OR p.day < i.until)
  AND ((i.kind = 'host' AND p.host = i.pattern) OR (i.kind = 'domain' AND (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)))
    OR (i.kind = 'prefix' AND (lower(p.host || p.path) = i.pattern OR starts_with(lower(p.host || p.path), i.pattern || '/'))))),
r AS (SELECT page_id, url, count(*) AS n, string_agg(rule, ',' ORDER BY rule) AS rules FROM m GROUP BY ALL)
SELECT p.page_id, p.url, strftime(DATE '2024-01-01' + p.day, '%Y-%m-%d') AS fetched_on, r.n IS NOT NULL AS blocked, CAST(coalesce(r.n, 0) AS BIGINT) AS n_rules, coalesce(r.rules, '') AS rules
FROM p LEFT JOIN r ON p.page_id = r.page_id AND p.url = r.url
"""
