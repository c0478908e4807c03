"""DuckDB SQL for the contract queries that SQL can express."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
    [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER ()
      - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w),
m AS (SELECT source, source_size, cap, w, max(level) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(w * level, cap::DOUBLE) AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
p AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part, target - floor(rate) * source_size AS left_over FROM r),
u AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.part, p.left_over,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, CASE WHEN part > 0 THEN (u / (1.0 - u)) / (part / (1.0 - part)) END AS rnk FROM u),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN part > 0 AND start + size / 2 <= left_over THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

OP8 = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
x AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS q(p) WHERE len(w) > 0),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
v AS (
  SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM x) AS ns, unnest(range(1, len(w) - n + 2)) AS q(p)),
h AS (SELECT v.rid, v.p, v.n, x.item_id FROM v JOIN x ON v.win = x.win AND v.n = x.n),
words AS (SELECT rid, count(DISTINCT o) AS n_hit FROM h, unnest(range(p, p + n)) AS q(o) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP3 = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
u AS (SELECT rid, vec_id, label, e FROM v WHERE ok),
l AS (
  SELECT a.rid AS ra, a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM u UNION SELECT l.b AS id, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT ra, count(*) AS n FROM l GROUP BY ra)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, v.vec_id) AS component_id,
  coalesce(v.vec_id = coalesce(m.c, v.vec_id), FALSE) AS kept
FROM v LEFT JOIN n ON n.ra = v.rid LEFT JOIN m ON v.ok AND m.id = v.vec_id
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS q(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.both >= 75 * (x.n + y.n - o.both)),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b AS id, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT rid, i, ls[i] AS line,
    translate(trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(ls) + 1)) AS q(i)),
f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
k AS (
  SELECT rid, count(*) AS n_lines, count(f.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL) AS kept
  FROM l LEFT JOIN f USING (key) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN k USING (rid)
"""

OP12 = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) AS r(i)),
f AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS n1,
    coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS z,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0 AS bad
  FROM documents, t),
h AS (SELECT doc_id, lang, sha256(a || n || z) AS leaf, CASE WHEN bad THEN sha256(a || n1 || z) END AS changed FROM f),
v AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    count(*) OVER (PARTITION BY lang) AS size FROM h),
nodes AS (
  SELECT g, 0 AS l, r AS k, leaf AS h, size AS n FROM v
  UNION ALL SELECT g, l + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, l, k // 2, n),
subs AS (SELECT g, l AS height, h AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS l, g AS k, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL SELECT l + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY l, k // 2, n),
low AS (SELECT DISTINCT g, l FROM nodes WHERE n > 1),
high AS (SELECT DISTINCT l FROM tops WHERE n > 1),
steps AS (
  SELECT v.g, v.r, low.l AS s, (v.r >> low.l) & 1 AS side, x.h FROM v JOIN low ON low.g = v.g LEFT JOIN nodes x ON x.g = v.g AND x.l = low.l AND x.k = xor(v.r >> low.l, 1::BIGINT)
  UNION ALL
  SELECT v.g, v.r, subs.height + high.l, (v.g >> high.l) & 1, x.h FROM v JOIN subs ON subs.g = v.g CROSS JOIN high LEFT JOIN tops x ON x.l = high.l AND x.k = xor(v.g >> high.l, 1::BIGINT)),
p AS (
  SELECT g, r, coalesce(string_agg(h, '' ORDER BY s) FILTER (WHERE h IS NOT NULL), '') AS proof,
    list(CASE WHEN h IS NULL THEN 'N' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY s) AS path
  FROM steps GROUP BY g, r),
o AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(changed, leaf)], coalesce(path, [])),
      lambda c, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || c WHEN 'R' THEN c || x[2:] ELSE c END)) AS folded_root
  FROM v JOIN subs USING (g) LEFT JOIN p USING (g, r))
SELECT *, folded_root = root AS verified FROM o
"""

ORACLES = {"op2_pareto_mixing": OP2, "op3_spherical_kmeans": OP3, "op4_adaptive_prefix_join": OP4, "op8_wu_manber": OP8, "op11_cuckoo_lines": OP11, "op12_nested_intervals": OP12}
