"""The queries of the training-data operators as DuckDB SQL, where SQL can state them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_SPACE = r"[ \t\n\x0B\f\r]+"

ORACLE["op1_quality_rules"] = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
split AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM texts),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
hits AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) > 1 AS again FROM windows),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM hits, (SELECT unnest(range(3)) AS k) WHERE again GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper
  FROM split LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
    + 64 * (3 * n_upper > word_chars)::BIGINT AS fail_bits FROM counts)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM bits
"""

_LETTERS = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op4_decontaminate"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, w, least(13, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
found AS (SELECT r, i, n, item_id FROM spans JOIN windows USING (n, v)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

ORACLE["op5_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text FROM documents),
raw AS (SELECT r, unnest(range(len(l))) AS j, unnest(l) AS x FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs)),
lines AS (
  SELECT r, j, x, row_number() OVER (PARTITION BY r ORDER BY j) AS i,
    len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')) AS w
  FROM raw WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]')),
packed AS (SELECT r, list(x ORDER BY i) AS x, list(w ORDER BY i) AS w FROM lines GROUP BY r),
starts AS (SELECT r, x, w, unnest(range(1, len(x) + 1)) AS s FROM packed),
runs AS (SELECT r, x, w, s, unnest(range(s, least(len(x), s + 49) + 1)) AS e FROM starts),
sized AS (SELECT r, s, e, x, w, list_sum(w[s:e]) AS n FROM runs),
shortest AS (
  SELECT r, s, e, array_to_string(x[s:e], chr(10)) AS v FROM sized
  WHERE n >= 50 AND (n - w[e] < 50 OR n - w[s] < 50)),
later AS (
  SELECT r, s, e FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY r, s) AS k FROM shortest) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, e + 1)) AS i FROM later),
kept AS (
  SELECT r, string_agg(raw.x, chr(10) ORDER BY raw.j) AS text, count(*) AS n
  FROM raw LEFT JOIN lines USING (r, j) LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY r),
counts AS (
  SELECT r, count(*) AS n_lines, count(gone.i) AS n_removed FROM lines LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN docs.text ELSE coalesce(kept.text, '') END AS text
FROM docs LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

_WHITE = r"[ \t\n\x0B\f\r]"

ORACLE["op10_quote_threads"] = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS raw
  FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw, r) - 1 AS position FROM rows),
cut AS (
  SELECT r, k, x, regexp_extract(x, '^(?:[ \t]*>)+') AS q
  FROM (SELECT r, unnest(range(len(l))) AS k, unnest(l) AS x FROM (SELECT r, string_split(raw, chr(10)) AS l FROM rows))),
lines AS (
  SELECT r, k, len(q) - len(replace(q, '>', '')) AS level,
    CASE WHEN q = '' THEN x ELSE regexp_replace(substr(x, len(q) + 1), '^[ \t]', '') END AS body FROM cut),
beside AS (SELECT *, lead(level) OVER (PARTITION BY r ORDER BY k) AS after, lag(level) OVER (PARTITION BY r ORDER BY k) AS before FROM lines),
marked AS (
  SELECT *, sum((before IS DISTINCT FROM level)::INT) OVER (PARTITION BY r ORDER BY k) AS run,
    level = 0 AND NOT (coalesce(after, 0) > 0 AND regexp_matches(body,
      '^{_WHITE}*(?:On\b[^\n]+\bwrote|Le\b[^\n]+\ba écrit|Am\b[^\n]+\bschrieb\b[^:\n]*|El\b[^\n]+\bescribió){_WHITE}*:{_WHITE}*$')) AS own
  FROM beside),
texts AS (
  SELECT r, regexp_replace(string_agg(body, chr(10) ORDER BY k) FILTER (own), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS text,
    count(*) FILTER (level > 0) AS n_quoted FROM marked GROUP BY r),
passages AS (
  SELECT r, 0 AS level, 0 AS run, string_agg(CASE WHEN own THEN body ELSE '' END, chr(10) ORDER BY k) AS p FROM marked GROUP BY r
  UNION ALL SELECT r, level, run, string_agg(body, chr(10) ORDER BY k) FROM marked WHERE level > 0 GROUP BY r, level, run),
paragraphs AS (SELECT r, level, run, unnest(regexp_split_to_array(p, '\n{_WHITE}*\n')) AS v FROM passages),
units AS (
  SELECT DISTINCT r, level, run, kind, trim(v) AS v FROM (
    SELECT r, level, run, kind, lower(trim(regexp_replace(v, '{_WHITE}+', ' ', 'g'))) AS v FROM (
      SELECT r, level, run, 0 AS kind, p AS v FROM passages
      UNION ALL SELECT r, level, run, 1, v FROM paragraphs
      UNION ALL SELECT r, level, run, 3, unnest(string_split(p, chr(10))) FROM passages)
    UNION ALL SELECT r, level, run, 2, unnest(regexp_extract_all(lower(trim(regexp_replace(v, '{_WHITE}+', ' ', 'g'))),
      '[^.!?]*[.!?]+|[^.!?]+')) FROM paragraphs) WHERE trim(v) <> ''),
said AS (SELECT units.*, conv_id, turn FROM units JOIN rows USING (r) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
spoken AS (SELECT DISTINCT conv_id, v, turn AS original FROM said WHERE level = 0),
found AS (
  SELECT q.r, q.level, q.run, q.kind, q.v, max(original) AS original FROM said q JOIN spoken USING (conv_id, v)
  WHERE q.level > 0 AND original < q.turn GROUP BY ALL),
votes AS (
  SELECT r, level, original, sum(len(v)) AS size
  FROM (SELECT * FROM found QUALIFY kind = min(kind) OVER (PARTITION BY r, run)) GROUP BY ALL),
best AS (
  SELECT r, original AS reply_to FROM votes
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY level, size DESC, original DESC) = 1)
SELECT conv_id, position, turn, role, coalesce(text, '') AS text, reply_to, coalesce(n_quoted, 0) AS n_quoted,
  '<|' || regexp_replace(role, '[<|>]|{_WHITE}', '', 'g') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |')
    || chr(10) || '<|end|>' AS formatted
FROM placed LEFT JOIN texts USING (r) LEFT JOIN best USING (r)
"""

#: The kinds of spans with their patterns and the group that is a value.
_SPANS = (
    ("assign", "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
               "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1),
    ("access", "AKIA[A-Z0-9]{16,}", 0), ("hex", "[0-9a-f]{24,}", 0),
    ("identifier", "\\b(?:user|username|login|account|client_id|access_key_id)[\"'']?\\x20*[:=]\\x20*[\"'']?"
                   "[A-Za-z0-9_.@-]{3,}", 0),
    ("random", "[A-Za-z0-9+/]{32,}={0,2}", 0),
    ("endpoint", "\\b(?:jdbc:)?\\w+(?:[+-]\\w+)*://[A-Za-z0-9_.:@/?&=%+-]{4,}", 0),
    ("break", "\\n[\\x20\\t\\r]*(?:(?:\\[[^\\]\\n]*\\]|-{3,}|={3,})[\\x20\\t\\r]*)?\\n", 0),
)


def _found(order: int, kind: str, pattern: str, group: int) -> str:
    return f"""
    SELECT r, {order} AS o, '{kind}' AS kind, k, length(m[k]) AS n, length(v[k]) AS value,
      list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT r, unnest(range(1, len(m) + 1)) AS k, m, v, p FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
        string_split_regex(t, '{pattern}') AS p FROM docs))"""


_LISTED = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e), '')"

ORACLE["op6_secret_scan"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT r, o, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM (
  {" UNION ALL ".join(_found(i, *x) for i, x in enumerate(_SPANS))}) WHERE kind <> 'assign' OR value >= 6),
base AS (SELECT * FROM found WHERE o < 3),
scoped AS (SELECT *, count(*) FILTER (kind = 'break') OVER (PARTITION BY r ORDER BY s) AS scope FROM found),
weak AS (
  SELECT * FROM scoped w WHERE o BETWEEN 3 AND 5 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT * FROM weak UNION ALL SELECT * FROM scoped WHERE kind = 'access'),
linked AS (
  SELECT * EXCLUDE (scope) FROM weak w WHERE EXISTS (
    SELECT 1 FROM parts x WHERE x.r = w.r AND x.scope = w.scope AND (x.s >= w.e OR x.e <= w.s)
      AND CASE w.kind WHEN 'identifier' THEN x.kind IN ('random', 'endpoint')
          WHEN 'random' THEN x.kind IN ('identifier', 'access', 'endpoint')
          ELSE x.kind IN ('identifier', 'access', 'random') END)),
counted AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, {_LISTED} AS spans FROM base GROUP BY r),
listed AS (SELECT r, {_LISTED} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(c.spans, '')) AS base_sha256, coalesce(l.spans, '') AS spans
FROM docs LEFT JOIN counted c USING (r) LEFT JOIN listed l USING (r)
"""

#: Five hexadecimal digits of SHA-1 are four characters of base 32.
_QUAD = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {b}) & 31) + 1, 1)" for b in (15, 10, 5, 0))

ORACLE["op13_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
digits AS (SELECT r, k, ('0x' || substr(sha1(h), (1 + 5 * k)::INT, 5))::BIGINT AS v FROM p, (SELECT unnest(range(8)) AS k)),
names AS (SELECT r, string_agg({_QUAD}, '' ORDER BY k) AS payload_digest FROM digits GROUP BY r),
ranked AS (
  SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS first_id FROM p
  WINDOW same AS (PARTITION BY h ORDER BY page_id NULLS LAST, r))
SELECT page_id, octet_length(encode(h)) AS payload_bytes, payload_digest,
  CASE place WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM ranked JOIN names USING (r)
"""
