"""DuckDB SQL that must give the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line FROM documents
), p AS (
  SELECT *, doc_id * 10000000 + no AS place, regexp_extract_all(line, '{WORD}') AS w FROM l
), d AS (
  SELECT line, min(place) AS place, any_value(w) AS w FROM p WHERE len(w) > 0 GROUP BY line
), e AS (
  SELECT line, place, array_to_string(w, ' ') AS whole, len(w) AS n, w FROM d WHERE len(w) >= 8
), v AS (
  SELECT line, place, i, array_to_string(w[1:i] || w[i + 2:], ' ') AS variant FROM (SELECT *, unnest(range(0, n)) AS i FROM e)
), vi AS (SELECT variant, i, min(place) AS place FROM v GROUP BY ALL),
va AS (SELECT variant, min(place) AS place FROM v GROUP BY ALL),
wh AS (SELECT whole, min(place) AS place FROM e GROUP BY ALL),
near AS (
  SELECT v.line FROM v JOIN vi ON v.variant = vi.variant AND v.i = vi.i AND vi.place < v.place
  UNION SELECT v.line FROM v JOIN wh ON v.variant = wh.whole AND wh.place < v.place
  UNION SELECT e.line FROM e JOIN va ON e.whole = va.variant AND va.place < e.place
), k AS (
  SELECT p.doc_id, p.no, p.line, d.place IS NULL OR (d.place = p.place AND near.line IS NULL) AS kept
  FROM p LEFT JOIN d ON p.line = d.line LEFT JOIN near ON p.line = near.line
)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(string_agg(k.line, chr(10) ORDER BY k.no) FILTER (k.kept), '') END AS text,
  count(*) FILTER (NOT k.kept) AS n_dropped
FROM documents t LEFT JOIN k ON t.doc_id = k.doc_id GROUP BY t.doc_id, t.text"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(least.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON d.doc_id = least.a"""

SOURCE_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), v AS (
  SELECT *, ((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, 3 * source_size <= weight * level AS filled, max(level) FILTER (NOT 3 * source_size <= weight * level) OVER () AS open_level FROM v
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN (3 * source_size)::DOUBLE
    ELSE least((3 * source_size)::DOUBLE, weight * open_level) END AS target,
    ('0x' || substr(md5(CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 6))::BIGINT AS start
  FROM o
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT,
    md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) AS k
  FROM d
), c AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.start, k.k,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216)::BIGINT ELSE 0 END AS each
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (least(((start + each * k) >> 24) - ((start + each * (k - 1)) >> 24), 3) * size)::BIGINT AS taken FROM c"""

_PIECE = r"[^.!?。！？]{0,400}[.!?。！？]{1,400} ?|[^.!?。！？]{1,400}"


def _digests(text: str) -> str:
    """Digests of a text's paragraphs, those over 400 code points cut after sentences."""
    units = f"""flatten(list_transform(list_filter(string_split({text}, chr(10)), lambda x: x <> ''),
      lambda x: CASE WHEN length(x) <= 400 THEN [x] ELSE regexp_extract_all(x, '{_PIECE}') END))"""
    return f"list_distinct(list_transform({units}, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT))"


FINGERPRINTS = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
    coalesce(lag(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next
  FROM documents
), e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next, 1, n_chars // 2) AS edited FROM t
), p AS (
  SELECT *, {_digests("text")} AS a, {_digests("edited")} AS b, {_digests("next")} AS c
  FROM e
), i AS (SELECT doc_id, 'a' AS side, unnest(a) AS x FROM p UNION ALL SELECT doc_id, 'b', unnest(b) FROM p),
cell AS (
  SELECT doc_id, side, third * 4 + (x % (1000003 + third * 10)) % 4 AS cell, count(*) AS c, bit_xor(x) AS i, bit_xor(x % 998244353) AS k
  FROM i, range(3) r(third) GROUP BY ALL
), f AS (
  SELECT p.doc_id, s.side, string_agg(coalesce(cell.c, 0) || ':' || format('{{:X}}', coalesce(cell.i, 0)) || ':' || format('{{:X}}', coalesce(cell.k, 0)), ' ' ORDER BY n) AS f
  FROM p CROSS JOIN (VALUES ('a'), ('b')) s(side) CROSS JOIN range(12) r(n) LEFT JOIN cell ON cell.doc_id = p.doc_id AND cell.side = s.side AND cell.cell = n
  GROUP BY p.doc_id, s.side
)
SELECT p.doc_id, n_chars, sha256(edited) AS edited_sha256, fa.f AS fingerprint, fb.f AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM p JOIN f fa ON p.doc_id = fa.doc_id AND fa.side = 'a' JOIN f fb ON p.doc_id = fb.doc_id AND fb.side = 'b'"""
