"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) END AS s FROM w),
c AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(s, chr(10)))) END AS class_id FROM s),
x AS (SELECT class_id, n, unnest(s) AS t FROM c WHERE doc_id = class_id),
links AS (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.t = b.t AND a.class_id <> b.class_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT class_id AS a, class_id AS b FROM c WHERE doc_id = class_id UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_shingles, class_id, component_id, coalesce(n_links, 0) AS n_links FROM c JOIN root r ON c.class_id = r.a LEFT JOIN degree d ON c.class_id = d.a
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM s GROUP BY 1),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM s JOIN f USING (s) WHERE m < doc_id),
run AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum((coalesce(gap, 51) > 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM run),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS gone, count(*) AS n FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
