"""SQL that states the results of the queries SQL can express, for whole tables at small scales."""

_VECTORS = """v AS (SELECT photo_id, vector FROM embedding WHERE photo_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY embedded_at DESC NULLS LAST) = 1),
u AS (SELECT photo_id, vector::DOUBLE[] AS x FROM v WHERE len(vector) = 128 AND len(list_filter(vector, lambda e: e IS NOT NULL AND isfinite(e))) = 128 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
s AS (SELECT l.photo_id AS a, r.photo_id AS b, list_cosine_similarity(l.x, r.x) AS c FROM u l JOIN u r ON l.photo_id < r.photo_id)"""

P1 = f"""
WITH {_VECTORS}, d AS (SELECT a AS q, b AS o, c FROM s WHERE c >= 0.65 UNION ALL SELECT b, a, c FROM s WHERE c >= 0.65),
t AS (SELECT q, o FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, o) <= 5)
SELECT DISTINCT least(q, o) AS photo_a, greatest(q, o) AS photo_b FROM t
"""

P4 = f"""
WITH RECURSIVE {_VECTORS}, e AS MATERIALIZED (SELECT a, b FROM s WHERE c >= 0.84), d AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk(n, seen) AS (SELECT a, a FROM d UNION SELECT d.b, w.seen FROM walk w JOIN d ON d.a = w.n),
k AS MATERIALIZED (SELECT n AS photo_id, min(seen) AS cluster_key FROM walk GROUP BY n),
m AS (SELECT l.photo_id, l.cluster_key, round(avg(list_cosine_similarity(x.x, y.x)), 9) AS mean FROM k l JOIN k r ON l.cluster_key = r.cluster_key AND l.photo_id <> r.photo_id JOIN u x ON x.photo_id = l.photo_id JOIN u y ON y.photo_id = r.photo_id GROUP BY ALL),
t AS (SELECT cluster_key, photo_id AS typical_id FROM m QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY mean DESC, photo_id) = 1)
SELECT photo_id, cluster_key, typical_id FROM k JOIN t USING (cluster_key)
"""

P5 = """
WITH r AS (SELECT DISTINCT ON (photo_id) photo_id, perceptual_hash AS h, color_histogram AS c, lower(trim(coalesce(channel_order, 'rgb'))) AS o FROM accepted
  WHERE photo_id IS NOT NULL AND perceptual_hash IS NOT NULL AND len(color_histogram) = 24 AND len(list_filter(color_histogram, lambda v: v >= 0 AND isfinite(v))) = 24 AND len(list_filter(color_histogram, lambda v: v > 0)) > 0 ORDER BY photo_id),
u AS (SELECT photo_id, h, list_concat(list_concat(c[instr(o, 'r') * 8 - 7 : instr(o, 'r') * 8], c[instr(o, 'g') * 8 - 7 : instr(o, 'g') * 8]), c[instr(o, 'b') * 8 - 7 : instr(o, 'b') * 8]) AS c FROM r)
SELECT l.photo_id AS photo_a, r.photo_id AS photo_b FROM u l JOIN u r ON l.photo_id < r.photo_id AND bit_count(xor(l.h, r.h)) <= 6 WHERE list_cosine_similarity(l.c, r.c) >= 0.98 - 1e-12
"""

P6 = r"""
WITH r AS (SELECT upper(regexp_replace(asset_key, '^\s+|\s+$', '', 'g')) AS k, record_id AS id, blur_score AS b, captured_at AS c,
  CASE lower(trim(timestamp_source)) WHEN 'exif' THEN 3 WHEN 'mtime' THEN 2 ELSE 1 END AS t, relative_path AS p, recorded_at AS ra FROM member_record WHERE record_id IS NOT NULL AND asset_key IS NOT NULL),
g AS (SELECT k FROM r WHERE k <> '' GROUP BY k HAVING count(DISTINCT id) > 1),
b AS (SELECT k, id FROM r WHERE b >= 0 AND NOT isnan(b) AND NOT isinf(b) QUALIFY row_number() OVER (PARTITION BY k ORDER BY b DESC, id) = 1),
c AS (SELECT k, id FROM r WHERE regexp_matches(c, '^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') AND try_cast(c AS TIMESTAMP) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, ra DESC NULLS LAST, id) = 1),
p AS (SELECT k, id FROM r WHERE regexp_replace(p, '\s', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ra DESC NULLS LAST, id) = 1)
SELECT g.k AS asset_key, coalesce(b.id, -1) AS blur_record_id, coalesce(c.id, -1) AS captured_record_id, coalesce(p.id, -1) AS path_record_id
FROM g LEFT JOIN b USING (k) LEFT JOIN c USING (k) LEFT JOIN p USING (k)
"""

P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
