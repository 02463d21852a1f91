"""SQL for DuckDB that gives the same rows as the queries beside it."""

_W = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
l AS (
  SELECT p.host, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM p JOIN labels ON labels.doc_id = p.page_id
  WHERE ((toxic = 1) OR (quality = 0)) IS NOT NULL GROUP BY 1),
u AS (SELECT DISTINCT host, string_split(host, '.') AS part FROM p),
v AS (
  SELECT host, part, len(part) AS k,
         CASE WHEN array_to_string(part[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz','co.in','com.cn','co.za') THEN 2 ELSE 1 END AS sl FROM u),
h AS (
  SELECT v.host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, array_to_string(part[-least(sl, k):], '.') AS suffix, array_to_string(part[-least(sl + 1, k):], '.') AS domain
  FROM v LEFT JOIN l USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
m0 AS (SELECT coalesce((sum(bad) + 0.2) / (sum(n) + 2.0), 0.1) AS m FROM s),
lv AS (SELECT 'h' AS lv, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0 UNION ALL SELECT 's', n, bad FROM s WHERE n > 0),
t AS (SELECT lv, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, count(*)::DOUBLE AS g, sum(bad * bad / n::DOUBLE) AS q FROM lv GROUP BY lv),
t2 AS (SELECT *, b / n AS m, CASE WHEN n > g AND b > 0 AND b < n THEN ((q - n * (b / n) * (b / n)) / ((b / n) * (1 - b / n)) - g) / (n - g) END AS r FROM t),
k AS (SELECT lv, least(greatest(CASE WHEN r > 0 THEN 1 / r - 1 ELSE 1000.0 END, 2.0), 1000.0) AS k FROM t2),
kk AS (SELECT coalesce(max(k) FILTER (lv = 'h'), 1000.0) AS kh, coalesce(max(k) FILTER (lv = 'd'), 1000.0) AS kd, coalesce(max(k) FILTER (lv = 's'), 1000.0) AS ks FROM k),
s1 AS (SELECT suffix, (bad + ks * m) / (n + ks) AS m1 FROM s, m0, kk),
d1 AS (SELECT domain, suffix, (bad + kd * m1) / (n + kd) AS m2 FROM d JOIN s1 USING (suffix), kk),
ab AS (SELECT host, n, bad, bad + kh * m2 AS a, n - bad + kh * (1 - m2) AS b FROM h JOIN d1 USING (domain, suffix), kk),
rep AS (SELECT host, n, bad, a / (a + b) AS mean, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS hv FROM ab),
j AS (
  SELECT p.*, n, bad, mean, bound, hv, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p JOIN rep USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' ELSE hv END AS verdict,
       n::BIGINT AS n_labelled, bad::BIGINT AS n_bad, round(mean, 6) AS bad_mean, round(bound, 6) AS bad_bound
FROM j
"""

_KEY = "lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"

#: A line on k of a host's n distinct pages is boilerplate: two at least, and more than one in ten by a score test with z * z = 2.7.
_OVER = "{k} >= 2 AND 10 * {k} > {n} AND 10 * (10 * {k} - {n}) * (10 * {k} - {n}) > 27 * 9 * {n}"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
tx AS (SELECT source, text, min(r) AS r FROM d GROUP BY ALL),
c AS (SELECT k.source, key, count(DISTINCT r) AS pages FROM k JOIN tx USING (r) WHERE key <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS host_pages FROM tx GROUP BY ALL),
b AS (SELECT c.source, key FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE {_OVER.format(k="pages", n="host_pages")}),
x AS (SELECT k.r, k.i, k.line FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key WHERE b.key IS NULL),
t AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM x GROUP BY r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, lang, source,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(t.text, '')) END AS n_chars
FROM d LEFT JOIN t USING (r)
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g2, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, source, line, {_KEY} AS key, len(regexp_extract_all(line, '{_W}')) AS n FROM (SELECT r, source, unnest(ls) AS line FROM w)),
f AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE n > 0 GROUP BY r),
tx AS (SELECT source, text, min(r) AS r FROM d GROUP BY ALL),
hd AS (SELECT source, count(*) AS host_docs FROM (SELECT DISTINCT tx.source, tx.r FROM tx JOIN l USING (r) WHERE l.n > 0) GROUP BY ALL),
c AS (SELECT l.source, l.key, count(DISTINCT l.r) AS line_docs FROM l JOIN tx USING (r) WHERE l.n > 0 GROUP BY ALL),
b AS (SELECT c.source, key FROM c JOIN hd ON c.source IS NOT DISTINCT FROM hd.source WHERE {_OVER.format(k="line_docs", n="host_docs")}),
lw AS (SELECT l.r, sum(CASE WHEN b.key IS NULL THEN l.n ELSE 0 END)::BIGINT AS words_left FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key GROUP BY l.r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, words_left
  FROM w LEFT JOIN f USING (r) LEFT JOIN rep USING (r) LEFT JOIN lw USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND words_left >= 0.3 * n_words AS kept FROM v
"""

#: Components of links (a, b): every node reaches the smallest.
_REACH = "reach(node, c) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.node WHERE r.c < l.b), comp AS (SELECT node, min(c) AS c FROM reach GROUP BY 1)"

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT DISTINCT a AS id FROM both_ways), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = doc_id
"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.95),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT DISTINCT a AS id FROM both_ways), {_REACH},
k AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN k ON a = vec_id LEFT JOIN comp ON node = vec_id
"""

_B32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::INT >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT) + 1, 1)), '')"

OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT html, max(page_id) AS m FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p JOIN g USING (html)
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS w, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * capitals > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(bad), 0) AS b FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS o FROM f v, f w, f x, f y, f z WHERE v.f NOT IN (w.f, x.f, y.f, z.f) AND w.f NOT IN (x.f, y.f, z.f) AND x.f NOT IN (y.f, z.f) AND y.f <> z.f),
s AS (SELECT o, k::INT AS step, 1 << (ascii(substr(o, k::INT, 1)) - 65) AS bit, list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(substr(o, j::INT, 1)) - 65))) AS before FROM o, range(1, 6) r(k)),
t AS (SELECT o, step, bit, coalesce(before, 0)::INT AS before FROM s),
x AS (SELECT part, o, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN b ELSE 0 END) AS toxic_lost
      FROM c, t GROUP BY ALL)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""

#: A conversation's key of a turn is the SHA-256 of role and text, kept apart by the role's length. crc32 goes byte by byte through its table.
OP11 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
             length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS key, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS chars FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295, chars), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM c, tab),
r AS (SELECT h.conv_id, 0 AS side, t.k, key, bytes FROM h JOIN t ON t.conv_id = h.base AND t.k <= h.h UNION ALL SELECT h.conv_id, 1, t.k, key, bytes FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, k) AS d, key, bytes FROM r),
n AS (SELECT conv_id, 0::BIGINT AS d, 'root' AS node, NULL::VARCHAR AS parent, 0::BIGINT AS bytes FROM h
      UNION ALL SELECT n.conv_id, s.d, sha256(n.node || '/' || s.key), n.node, s.bytes FROM n JOIN s ON s.conv_id = n.conv_id AND s.d = n.d + 1),
e AS (SELECT conv_id, max(d) AS last FROM n GROUP BY 1),
g AS (SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last), '')) AS ends FROM n JOIN e USING (conv_id) GROUP BY node),
ch AS (SELECT parent, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY 1),
up AS (SELECT node AS top, node, parent, bytes, n, d FROM g UNION ALL SELECT p.node, up.node, p.parent, up.bytes, up.n, up.d FROM up JOIN g p ON p.node = up.parent),
sub AS (SELECT top, count(*) FILTER (ch.parent IS NULL) AS n_leaves, sum((up.n - 1) * bytes) AS saved FROM up LEFT JOIN ch ON ch.parent = up.node GROUP BY 1)
SELECT g.conv_id, g.d::BIGINT AS depth, p.conv_id AS parent_conv_id, g.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
FROM g LEFT JOIN g p ON p.node = g.parent LEFT JOIN ch ON ch.parent = g.node JOIN sub ON sub.top = g.node
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, i FROM k JOIN f USING (k) WHERE first < doc_id),
x AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM g),
n AS (SELECT r, count(*) AS n FROM x GROUP BY 1),
e AS (SELECT d.r, w, unnest(range(1, len(w) + 1)) AS i FROM d JOIN n USING (r)),
t AS (SELECT e.r, string_agg(w[e.i], ' ' ORDER BY e.i) AS t FROM e LEFT JOIN x ON x.r = e.r AND x.i = e.i WHERE x.r IS NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

ORACLE_SQL = {"op1_url_reputation": OP1, "op3_ngram_jaccard": OP3, "op4_pq_near_dedup": OP4, "op7_line_dedup": OP7, "op8_quality_rules": OP8, "op10_warc": OP10, "op11_prefix_trie": OP11, "op12_filter_audit": OP12, "op13_substring_dedup": OP13}
