"""SQL for the queries whose rows DuckDB can state."""

#: A SHA-1 in hex as bare upper-case base32: each five hex digits are four base-32 digits.
BASE32 = (
    "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + (((('0x' || substr({hex}, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT), 1)), 'string_agg', '')"
)

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, {BASE32.format(hex="hex")} AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

OP5 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS shingles
  FROM t
),
c AS (SELECT doc_id, len(shingles) AS n, shingles, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS rep FROM s),
e AS (SELECT rep, n, unnest(shingles) AS x FROM c WHERE doc_id = rep),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS root FROM c WHERE doc_id = rep UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c JOIN m ON c.rep = m.node
"""

OP4 = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line, ls FROM t),
l AS (SELECT DISTINCT doc_id, line, regexp_extract_all(ls[line + 1], '[^\x20\x09-\x0D]+') AS w FROM u),
m AS (SELECT *, {'d': doc_id, 'n': line} AS pl FROM l WHERE len(w) >= 5),
c AS (SELECT w, min(pl) AS first FROM m GROUP BY w),
h AS (SELECT w, first, len(w) AS n, unnest([len(w), len(w) + 1]) AS c FROM c),
k AS (SELECT w, first, n, c, 'first' AS side, w[1:(c - 1) // 2] AS part FROM h UNION ALL SELECT w, first, n, c, 'last', w[n - (c - 1) // 2 + 1:n] FROM h),
p AS (SELECT DISTINCT a.w AS aw, a.first AS a, b.w AS bw, b.first AS b FROM k a JOIN k b ON a.side = b.side AND a.c = b.c AND a.part = b.part AND a.first < b.first WHERE abs(a.n - b.n) <= 1),
q AS (SELECT a, b, len(aw) AS x, len(bw) AS y, least(x, y) AS z,
  coalesce(nullif(list_position(list_transform(range(1, z + 1), lambda i: aw[i] = bw[i]), false), 0) - 1, z) AS pre,
  coalesce(nullif(list_position(list_transform(range(1, z + 1), lambda i: aw[x - i + 1] = bw[y - i + 1]), false), 0) - 1, z) AS suf FROM p),
e AS (SELECT b, min(a) AS keep FROM q WHERE greatest(x, y) - least(z, pre + suf) <= 1 GROUP BY b),
f AS (SELECT c.w, c.first, coalesce(e.keep, c.first) AS keep FROM c LEFT JOIN e ON e.b = c.first)
SELECT m.doc_id, m.line::INTEGER AS line, f.keep.d AS keep_doc_id, f.keep.n::INTEGER AS keep_line, (f.keep < f.first)::INTEGER AS edits FROM m JOIN f ON m.w = f.w WHERE f.keep < m.pl
"""

ORACLES = {"op4_linedup": OP4, "op1_warc": OP1, "op5_superminhash": OP5}
