"""DuckDB SQL of the operators that SQL can express, over the tables the driver registers as views."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# CRC-32 by its table of 256, eight steps an entry, over the ASCII codes of a text.
_STEP = "if({0} % 2 = 1, xor({0} >> 1, 3988292384::BIGINT), {0} >> 1)"
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
         list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
         lambda crc, b: xor(crc >> 8, crc_table.t[(xor(crc, b) & 255) + 1])))"""

# Edits of a row in state q (0 nothing yet, 1 after s, 2 after u, 3 after a) after k insertions.
_INSERTED = """SELECT s.conv_id, s.i, CASE WHEN k = 0 THEN q WHEN (q = 2) = (k = 1) THEN 3 ELSE 2 END AS q, cost + 2 * k AS cost,
       audit || repeat('I', k) AS audit,
       out || CASE WHEN k = 0 THEN [] WHEN q = 2 THEN ['assistant:', 'user:'][1:k] ELSE ['user:', 'assistant:'][1:k] END AS out
FROM {} s, unnest([0, 1, 2]) AS ins(k)"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACES})")} AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT keyed.*, coalesce(doc_id <> keep_id, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id""",
    "op9_exact_dedup": f"""
WITH norm AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)""",
    "op12_conversation_repair": f"""
WITH RECURSIVE crc_table AS (
  SELECT list(t ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: {_STEP.format('c')}) AS t FROM range(256) AS r(n))),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations, crc_table), unnest(if(kind = 0, [], if(kind = 3, [1, 2], [1]))) AS copies(c)),
placed AS (
  SELECT *, rtrim(text, {_SPACES}) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
edits AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS out FROM faulty
  UNION ALL
  SELECT conv_id, i, q, cost, audit, out FROM (
    SELECT r.conv_id, r.i, CASE letter WHEN 'D' THEN q WHEN 'K' THEN (CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END)
             ELSE if(q = 2, 3, 2) END AS q,
           cost + CASE letter WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + (letter <> 'D' AND fault = 'truncated')::INT AS cost,
           audit || letter AS audit,
           out || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                  ELSE [if(q = 2, 'assistant:', 'user:') || text] END AS out
    FROM ({_INSERTED.format('edits')}) s JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1,
         unnest(['D', 'K', 'R']) AS e(letter)
    WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR (q = 0 AND initial = 's')
          OR (q <> 2 AND initial = 'u') OR (q = 2 AND initial = 'a')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
sizes AS (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id),
best AS (
  SELECT f.* FROM ({_INSERTED.format('edits')}) f JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = z.n
  WHERE q IN (0, 3) QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY cost, audit) = 1),
pairs AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_decontamination": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM docs, (SELECT DISTINCT n FROM phrases) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT doc_id, n, i, item_id FROM runs JOIN phrases USING (n, p)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN met USING (doc_id)""",
}
