"""SQL counterparts of operators whose rows SQL can give by brute force, for small tables only."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS gram
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP5_SQL = r"""
WITH bytes AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM bytes WHERE n >= 400)
), marked AS (
  SELECT doc_id, s, times FROM starts JOIN (SELECT k, count(*) AS times FROM starts GROUP BY k HAVING count(*) > 1) USING (k)
), islands AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
    SELECT doc_id, s, (s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) > 400)::INT AS fresh FROM marked WHERE times > 1)
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM islands GROUP BY doc_id, island
), cut AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
  SELECT c.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM cut c JOIN bytes USING (doc_id) GROUP BY c.doc_id
), words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w FROM documents
), strings AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 49], '') || regexp_extract(w[i + 50], '[^\x20\x09-\x0D]+')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 51)
  UNION ALL SELECT DISTINCT doc_id, k FROM starts
), passages AS (
  SELECT DISTINCT doc_id FROM strings WHERE k IN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1)
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256, doc_id IN (FROM passages) AS repeats_passage
FROM bytes LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), least AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reached GROUP BY x
)
SELECT vec_id, count(l.x) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN links l ON l.x = vec_id GROUP BY vec_id, component_id
"""
