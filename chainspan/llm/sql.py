"""SQL that the queries over conversations and archives must agree with."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, which DuckDB has no function for."""
    byte = "list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)"
    return f"CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda a, b: {byte}), 4294967295::UBIGINT) AS BIGINT)"


TRIE = f"""
WITH given AS (
  SELECT conv_id, turn, left(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS k, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM given),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS head, {crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM given)),
b AS (
  SELECT c.conv_id, 0 AS part, t.i, t.k, t.bytes FROM c JOIN t ON t.conv_id = c.head AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.k, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, k, bytes FROM b),
p AS (
  SELECT conv_id, depth, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM p GROUP BY path),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
under AS (
  SELECT left(path, 32 * above) AS path, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS above FROM whole) GROUP BY 1),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) WHERE depth = last GROUP BY path)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN under u USING (path) LEFT JOIN ends e USING (path) LEFT JOIN n up ON w.depth > 0 AND up.path = left(w.path, 32 * (w.depth - 1))
"""


def _plus(v: str, cost: str, letter: str) -> str:
    """An audit with its cost in front, which sorts as the pair does, after one more edit."""
    return f"(lpad((substr({v}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({v}, 13) || '{letter}')"


def _keep(v: str, initial: str) -> str:
    return f"CASE WHEN stays AND initial = '{initial}' THEN {_plus(v, 'extra', 'K')} END"


def _rename(v: str) -> str:
    return f"CASE WHEN stays THEN {_plus(v, '1 + extra', 'R')} END"


def _ins(v: str) -> str:
    return _plus(v, "5", "I")


_W2 = f"least(v2, {_ins('v0')}, {_ins('v1')}, {_ins('v3')})"
_MADE = f"SELECT *, least(v3, {_ins('w2')}) AS w3 FROM (SELECT *, v0 AS w0, v1 AS w1, {_W2} AS w2 FROM walk)"

STRUCTURE = f"""
WITH RECURSIVE d0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations),
d1 AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, f FROM d0 WHERE f <> 0),
d2 AS (SELECT conv_id, turn, role, text FROM d1 UNION ALL SELECT conv_id, turn, role, text FROM d1 WHERE f = 3),
d3 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i, left(role, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM d2)),
r AS (
  SELECT *, fault IN (0, 3) AS stays, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM (SELECT *, CASE WHEN rest = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM d3)),
known AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST('000000000000' AS VARCHAR) AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM known
  UNION ALL
  SELECT m.conv_id, r.i, {_plus("w0", "2", "D")}, least({_plus("w1", "2", "D")}, {_keep("w0", "s")}),
    least({_plus("w2", "2", "D")}, {_keep("w0", "u")}, {_keep("w1", "u")}, {_keep("w3", "u")}, {_rename("w0")}, {_rename("w1")}, {_rename("w3")}),
    least({_plus("w3", "2", "D")}, {_keep("w2", "a")}, {_rename("w2")})
  FROM ({_MADE}) m JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i + 1),
best AS (
  SELECT conv_id, substr(v, 1, 12)::BIGINT AS cost, substr(v, 13) AS audit
  FROM (SELECT conv_id, i, max(i) OVER (PARTITION BY conv_id) AS n, least(w0, w3) AS v FROM ({_MADE})) WHERE i = n),
letters AS (
  SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS p FROM best WHERE audit <> '')),
kept AS (
  SELECT l.conv_id, l.p, l.letter, r.role, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text, l.letter = 'K' AND r.initial = 's' AS opening
  FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
placed AS (SELECT *, count(*) FILTER (NOT opening) OVER (PARTITION BY conv_id ORDER BY p) AS place FROM kept),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM placed GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
  coalesce(f.illegal, 0) AS illegal, b.cost, b.audit, sha256(coalesce(l.whole, '')) AS repaired_sha256
FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id
"""

# Base 32 of 160 bits: four groups of 40 bits, each of eight letters.
_BASE32 = " || ".join(
    "array_to_string(list_transform(range(8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"CAST((('0x' || substr(sha1(body), {10 * g + 1}, 10))::BIGINT >> (35 - 5 * j)::BIGINT) & 31 AS INTEGER) + 1, 1)), '')"
    for g in range(4)
)
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN owner END AS refers_to
FROM o
"""
