"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{UPPER.lower()}')"


_BREAKS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP3 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_lower("coalesce(text, '')")}, {_BREAKS}) AS w
  FROM documents
),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, w, least(len(w), 10) AS k
  FROM (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_BREAKS}) AS w FROM benchmark)
  WHERE len(w) > 0
),
passages AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM items)
),
sizes AS (SELECT DISTINCT k FROM passages),
starts AS (
  SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM docs JOIN sizes ON len(w) >= k
),
found AS (
  SELECT r, s, p.k, item_id
  FROM starts JOIN passages p ON p.k = starts.k AND p.gram = array_to_string(w[s : s + starts.k - 1], ' ')
),
hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit
  FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS pos FROM found) GROUP BY r
),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP4 = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''),
    lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS b
  FROM payloads
),
digests AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex) AS holder,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           16 * CAST(substr(b, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * i + 2 AS INT), 1) AS INT)
           + 4 * CAST(substr(b, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * i + 4 AS INT), 1) AS INT)
           + CAST(substr(b, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest
  FROM bits
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM digests
"""

OP7 = f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size
  FROM documents
),
totals AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY s),
weighed AS (
  SELECT s, source_size, source_size * 2.0::DOUBLE AS bound, CAST(sum(source_size) OVER () AS DOUBLE) AS all_words,
         CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM totals
),
levels AS (
  SELECT *, (all_words * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, s
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY bound / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
),
targets AS (
  SELECT s, source_size, least(bound, weight * max(level) OVER ()) AS target FROM levels
),
ranked AS (
  SELECT doc_id, size, s, source_size, target,
         CAST(row_number() OVER (PARTITION BY s ORDER BY length(bin(size)), substr(bin(size), 1, 4),
           substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id NULLS FIRST) AS DOUBLE) AS k,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || s), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized JOIN targets USING (s)
)
SELECT doc_id, size, source_size, target,
       CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) * size AS taken
FROM ranked
"""

OP8 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
lines AS (
  SELECT r, doc_id, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS line FROM docs
),
keyed AS (SELECT *, {_lower(f"trim(line, {SPACES})")} AS key FROM lines),
keys AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT r, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN keys USING (key)
),
joined AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN joined USING (r)
"""

OP11 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
),
windows AS (
  SELECT r, doc_id, s, array_to_string(w[s : s + 19], ' ') AS words
  FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS s FROM docs WHERE len(w) >= 20)
),
judged AS (
  SELECT r, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) > 1 AS later FROM windows
),
gone AS (
  SELECT DISTINCT r, unnest(generate_series(s, s + 19)) AS pos FROM judged WHERE later
),
words AS (
  SELECT r, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word FROM docs
),
kept AS (
  SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS words
  FROM words ANTI JOIN gone USING (r, pos) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

#: CRC-32 of the id's digits, bit by bit: every digit is mixed in with the first of its eight shifts.
_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda state, x: xor(xor(state, x) >> 1, CASE WHEN xor(state, x) % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""

OP12 = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') || chr(0) || coalesce(text, '') AS said,
         len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS n_words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, nth AS pos, said, n_words
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND nth <= h
  UNION ALL
  SELECT conv_id, 10 + nth, said, n_words FROM convs JOIN turns USING (conv_id) WHERE nth > h
),
lists AS (
  SELECT conv_id, coalesce(list(said ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS way,
         coalesce(list(n_words ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS sizes
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
),
steps AS (
  SELECT conv_id, way, sizes, len(way) AS n, unnest(generate_series(0, len(way))) AS depth FROM lists
),
paths AS (
  SELECT conv_id, depth, n, sha256(array_to_string(way[1 : depth], chr(1))) AS node,
         CASE WHEN depth > 0 THEN sha256(array_to_string(way[1 : depth - 1], chr(1))) END AS above,
         CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS n_words
  FROM steps
),
nodes AS (
  SELECT depth, node, above, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_words) AS n_words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), ''))
           AS ends_sha256
  FROM paths GROUP BY depth, node, above
),
children AS (
  SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
),
below AS (
  SELECT DISTINCT u.depth, u.node, d.depth AS low_depth, d.node AS low
  FROM paths u JOIN paths d ON u.conv_id = d.conv_id AND d.depth >= u.depth
),
totals AS (
  SELECT b.depth, b.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves,
         sum((n.n_convs - 1) * n.n_words) AS saved_tokens
  FROM below b JOIN nodes n ON n.depth = low_depth AND n.node = low
  LEFT JOIN children c ON c.depth = low_depth AND c.node = low
  GROUP BY b.depth, b.node
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       nodes.ends_sha256
FROM nodes JOIN totals USING (depth, node) LEFT JOIN children USING (depth, node)
LEFT JOIN nodes up ON up.depth = nodes.depth - 1 AND up.node = nodes.above
"""


def oracles() -> dict[str, str]:
    return {
        "op3_decontamination": OP3,
        "op4_warc": OP4,
        "op7_mixing": OP7,
        "op8_line_dedup": OP8,
        "op11_substring_dedup": OP11,
        "op12_prefix_trie": OP12,
    }
