"""DuckDB SQL for the queries that SQL can express."""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     k AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
                  CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS stored FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN stored IS NULL OR stored IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN stored IS DISTINCT FROM page_id THEN stored END AS refers_to
FROM k
"""

OP4 = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP6 = """
WITH RECURSIVE
  d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
  e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(seen) FROM r WHERE r.node = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     t AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
     s AS MATERIALIZED (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM t),
     f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM s WHERE n = 20),
     r AS MATERIALIZED (SELECT t.doc_id, t.i, word, coalesce(max(again::INT) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.i = t.i),
     g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""

#: crc32 of a text bit by bit: no built-in function has it.
CRC32 = """xor(list_reduce([4294967295::UBIGINT] || list_transform(split({text}, ''), lambda x: ascii(x)::UBIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT FOR _ IN range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::UBIGINT)::BIGINT"""

OP12 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {CRC32.format(text="doc_id::VARCHAR")} AS h FROM documents),
     e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
     t AS MATERIALIZED (SELECT doc_id, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM e)),
     p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
     g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS same FROM p),
     s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY doc_id, q, same HAVING count(*) >= greatest(12 - q, q)),
     r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
     k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id),
     b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM r),
     f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND place = 1
"""

def _op11() -> str:
    """Three rounds of full scans, then a last one."""
    nearest = """n{r} AS MATERIALIZED (SELECT r, vec_id, q, cluster, distance FROM (
        SELECT r, vec_id, v.q, c.cluster, list_sum(list_transform(range(1, 65), lambda p: (v.q[p] - c.q[p]) * (v.q[p] - c.q[p])))::BIGINT AS distance,
               row_number() OVER (PARTITION BY r ORDER BY distance, c.cluster) AS place
        FROM v, c{r} c) WHERE place = 1)"""
    moved = """c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS q FROM (
            SELECT cluster, p, sum(q[p])::BIGINT AS s, count(*) AS n FROM n{r}, range(1, 65) t(p) GROUP BY cluster, p) GROUP BY cluster) m USING (cluster))"""
    steps = [x for r in range(3) for x in (nearest.format(r=r), moved.format(r=r, n=r + 1))] + [nearest.format(r=3)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
         WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster, q FROM v QUALIFY cluster < 16),
     {", ".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM n3 JOIN c3 c USING (cluster)
"""


SQL = {"op11_yinyang": _op11(), "op12_periodic_runs": OP12, "op6_jaccard": OP6, "op8_repeats": OP8, "op3_warc_bundles": OP3, "op4_exact_dedup": OP4}
