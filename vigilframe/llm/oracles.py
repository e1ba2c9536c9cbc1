"""SQL twins of the queries that SQL can state."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op4_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op9_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), found AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL["op1_near_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
        FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n a ON a.doc_id = p.a JOIN n b ON b.doc_id = p.b
  WHERE 100 * common >= 85 * (a.n + b.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""

SQL["op2_sharding"] = r"""
WITH RECURSIVE shard AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name,
         ('0x' || substr(md5(name || '/start'), 1, 15))::BIGINT % 1613 AS start,
         ('0x' || substr(md5(name || '/step'), 1, 15))::BIGINT % 1612 + 1 AS step
  FROM range(0, 16) t(i)
), orders AS (
  SELECT list(o ORDER BY i) AS o
  FROM (SELECT i, list_transform(range(0, 1613), lambda j: (start + j * step) % 1613) AS o FROM shard)
), turns AS (
  SELECT 0 AS t, []::BIGINT[] AS taken
  UNION ALL
  SELECT t + 1, list_append(taken, list_filter(o[t % 16 + 1], lambda s: NOT list_contains(taken, s))[1])
  FROM turns, orders WHERE t < 1613
), slots AS (
  SELECT unnest(taken) AS slot, (unnest(range(0, 1613)) % 16)::INT AS i FROM turns WHERE t = 1613
), d AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 1613 AS slot FROM documents
)
SELECT doc_id, slot, name AS shard FROM d JOIN slots USING (slot) JOIN shard USING (i)"""

# crc32 has no DuckDB function: the checksum of (file, seq) is folded over the bits of its bytes
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(file || '/' || seq, ''),
  lambda ch: ascii(ch)::BIGINT)), lambda acc, byte:
  list_reduce(list_prepend(xor(acc, byte), range(0, 8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""


def _level(k: int, side: str) -> str:
    below = f"{side}{k - 1}"
    return f"""{side}{k} AS (
  SELECT file, idx // 16 AS idx, min(s) AS s, max(e) AS e,
         sha256(min(s) || '|' || max(e) || '|' || string_agg(hash, '|' ORDER BY idx)) AS hash
  FROM {below} GROUP BY file, idx // 16)"""


SQL["op3_warc_fixity"] = rf"""
WITH r AS (
  SELECT page_id // 512 AS file, page_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:md5:' || md5(page_id || '/' || url) || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
         || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), p AS (
  SELECT file, row_number() OVER w - 1 AS seq, sum(strlen(record)) OVER w - strlen(record) AS s,
         sum(strlen(record)) OVER w AS e, record
  FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)
), m AS (SELECT *, xor({_CRC}, 4294967295::BIGINT) AS mark FROM p),
a0 AS (SELECT file, seq AS idx, s, e, sha256(record) AS hash FROM m),
b0 AS (
  SELECT file, seq AS idx, s, e,
         sha256(CASE WHEN mark % 37 = 3 THEN left(record, 59) || '#' || substr(record, 61) ELSE record END) AS hash
  FROM m WHERE mark % 101 <> 5
), {", ".join(_level(k, side) for side in "ab" for k in (1, 2, 3))}
SELECT file, idx AS seq, a0.s::BIGINT AS start_offset, a0.e::BIGINT AS end_offset,
       CASE WHEN b0.hash IS NULL THEN 'lost' ELSE 'changed' END AS kind, a0.hash AS expected_sha256,
       b0.hash AS found_sha256, a3.hash AS root, b3.hash AS found_root
FROM a0 LEFT JOIN b0 USING (file, idx) JOIN a3 USING (file) LEFT JOIN b3 USING (file)
WHERE b0.hash IS DISTINCT FROM a0.hash"""

SQL["op12_phrases"] = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN range(1, 6) t(k)
        WHERE len(w) >= k)
  GROUP BY ALL
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
inner_phrase AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c CROSS JOIN range(2, 5) t(m) WHERE m < k)
  GROUP BY ALL
), cut AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, n, j,
         (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN total USING (lang)
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, j), ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, j + 1, c.k), ' ')
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM lowest LEFT JOIN inner_phrase USING (lang, phrase)
WHERE longer IS NULL OR longer < a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
