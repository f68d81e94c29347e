"""SQL, for DuckDB, that the queries must agree with where SQL can express them."""

from __future__ import annotations

from . import quality_rules as qr

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"[\x20\x09-\x0D]+"

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")))
OP1 = rf"""
WITH r(verdict, h, p) AS (VALUES {_RULES}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), {_AZ}), '{_SPACE}') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(id, seen) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.seen),
c AS (SELECT id, min(seen) AS least FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(least, s.doc_id)) AS kept FROM s LEFT JOIN c ON id = s.doc_id"""


def _severity() -> str:
    pairs = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_chars": ("word_chars", "n_words")}
    return "greatest(" + ", ".join("(" + " + ".join(f"CAST({a} * 100 > {b} * {cut} AS INTEGER)" for cut in qr.GRID[rule]) + ")" for rule, (a, b) in pairs.items()) + ")"


_TAILS = " UNION ALL ".join(f"SELECT stratum, n, count_if(severity > {qr.LEVELS - x}) AS k FROM seen GROUP BY stratum, n" for x in range(1, qr.LEVELS + 1))
OP4 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS t, [x FOR x IN string_split_regex(coalesce(text, ''), '{_SPACE}') IF x <> ''] AS ws, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_severity()} AS severity FROM c),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
seen AS (SELECT stratum, severity, count(*) OVER (PARTITION BY stratum) AS n FROM s SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
tests AS ({_TAILS}),
p AS (SELECT stratum, n, k, CASE WHEN k >= n * {qr.ALPHA} THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({qr.ALPHA}) + (n - i) * ln(1 - {qr.ALPHA})) FOR i IN range(0, CAST(k AS BIGINT) + 1)]) END AS p FROM tests),
least AS (SELECT stratum, {qr.LEVELS + 1} - count_if(p <= {qr.DELTA} / (SELECT greatest(1, count(DISTINCT stratum)) FROM s)) AS least FROM p GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND severity < coalesce(least, {qr.LEVELS + 1}) AS kept FROM s LEFT JOIN least USING (stratum)"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[{g}] >> {s}) & 31) + 1 AS BIGINT), 1)" for g in range(1, 9) for s in (15, 10, 5, 0))
OP10 = f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, [CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) FOR i IN range(0, 8)] AS v FROM h),
e AS (SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to FROM e WINDOW w AS (PARTITION BY payload_digest)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS ts FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(coalesce(sum(len(ts)), 0) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}')) AS t FROM benchmark),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) SEMI JOIN it USING (t) GROUP BY r, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t, big_n),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // l))))) AS BIGINT) AS score FROM tf JOIN w USING (t) JOIN it USING (t), c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit: DuckDB has no function for it."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


OP12 = f"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM ids),
q AS (SELECT c, 0 AS own, pos, role, text FROM h JOIN t ON conv_id = base AND pos <= h UNION ALL SELECT c, 1 AS own, pos, role, text FROM h JOIN t ON conv_id = c AND pos > h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, md5(md5(role) || md5(text)) AS x, length(text) AS chars FROM q),
p AS (SELECT c, depth, chars, string_agg(x, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM r UNION ALL SELECT c, 0 AS depth, 0 AS chars, '' AS path FROM ids),
node AS (SELECT path, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n FROM p GROUP BY path),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, max(path) AS path FROM p GROUP BY c) GROUP BY path),
up AS (SELECT left(path, 32 * CAST(a AS BIGINT)) AS path, count_if(k IS NULL) AS leaves, sum((n - 1) * chars) AS saved FROM (SELECT path, k, n, chars, unnest(range(0, depth + 1)) AS a FROM node LEFT JOIN kids USING (path)) GROUP BY 1)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM node LEFT JOIN kids USING (path) JOIN up USING (path) LEFT JOIN e USING (path) LEFT JOIN node AS parent ON node.depth > 0 AND parent.path = left(node.path, 32 * (node.depth - 1))"""

ORACLE_SQL = {"op1_url_filter": OP1, "op2_minhash_dedup": OP2, "op4_quality_rules": OP4, "op10_warc": OP10, "op11_lexical_search": OP11, "op12_prefix_trie": OP12}
