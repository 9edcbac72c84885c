"""The same results in DuckDB's SQL, for the operators that SQL can state: by brute force over all pairs."""

from __future__ import annotations

from wikiloom.llm.licenses import DICE, TEMPLATES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{pattern}')"


_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text", _PLAIN)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _PLAIN)} AS w FROM benchmark),
bk AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM bw))),
hit AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, g)),
place AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM place GROUP BY doc_id),
m AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

_REACH = """
reach(a, b) AS (SELECT id, id FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
node AS (SELECT id FROM v),
link AS (SELECT x.id AS a, y.id AS b FROM v AS x JOIN v AS y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH.strip()}
SELECT node.id AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, comp.component_id, node.id = comp.component_id AS kept
FROM node JOIN comp ON node.id = comp.id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) AS k ON node.id = k.a
"""

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, {_words("text", r"[^\x20\x09-\x0D]+")} AS w FROM documents),
node AS (SELECT id FROM d),
s AS (SELECT DISTINCT id, g FROM (
  SELECT id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id),
link AS (SELECT a, b FROM common JOIN n AS p ON p.id = a JOIN n AS q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_REACH.strip()}
SELECT node.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, node.id = comp.component_id AS kept
FROM node JOIN comp ON node.id = comp.id LEFT JOIN n ON node.id = n.id
"""

_NOTICES = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in TEMPLATES)
_GRAMS = "list_distinct(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)"

LICENSES = rf"""
WITH t AS (SELECT license, {_words("notice", _PLAIN)} AS w FROM (VALUES {_NOTICES}) AS v(license, notice)),
tg AS (SELECT row_number() OVER (ORDER BY license, w) AS notice, license, {_GRAMS} AS g FROM t),
line AS (SELECT doc_id, {_words("t", _PLAIN)} AS w, n FROM (
  SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\r\n]+') AS l FROM documents))),
lg AS (SELECT doc_id, n, {_GRAMS} AS g FROM line WHERE len(w) >= 1),
le AS (SELECT doc_id, n, len(g) AS size, unnest(g) AS g FROM lg),
te AS (SELECT notice, license, len(g) AS size, unnest(g) AS g FROM tg),
common AS (SELECT doc_id, n, notice, license, 2 * count(*) / (le.size + te.size) AS dice FROM le JOIN te ON le.g = te.g GROUP BY doc_id, n, notice, license, le.size, te.size),
best AS (SELECT doc_id, n, license, dice, max(dice) OVER (PARTITION BY doc_id, n) AS top FROM common WHERE dice >= {DICE}),
named AS (SELECT doc_id, license, count(DISTINCT n) AS passages, max(dice) AS dice FROM best WHERE dice = top GROUP BY doc_id, license),
found AS (SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, sum(passages) AS n_passages, max(dice) AS best FROM named GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages,
  round(coalesce(best, CAST(0 AS DOUBLE)), 6) AS best
FROM documents AS d LEFT JOIN found ON d.doc_id = found.doc_id
"""

CHAT = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (SELECT conv_id, turn AS n, coalesce(text, '') AS text, CASE WHEN turn % 5 = 0 THEN 'b0' ELSE concat('b', turn) END AS id FROM t WHERE role = 'assistant'),
b AS (SELECT *, n = min(n) OVER (PARTITION BY conv_id, id) AS own, CASE WHEN n % 7 = 0 THEN id ELSE concat('b', n - 2) END AS need FROM s),
known AS (SELECT DISTINCT conv_id, id FROM b),
level(conv_id, id, level) AS (
  SELECT conv_id, id, 0 FROM b WHERE own AND (conv_id, need) NOT IN (SELECT (conv_id, id) FROM known)
  UNION ALL SELECT b.conv_id, b.id, level + 1 FROM b JOIN level ON b.conv_id = level.conv_id AND b.need = level.id WHERE own AND b.id <> b.need),
f AS (SELECT b.*, CASE WHEN own THEN level END AS level, (b.conv_id, need) NOT IN (SELECT (conv_id, id) FROM known) AS lost,
  CASE WHEN n % 2 = 0 THEN concat('"found ', n, '"') END AS result_a, CASE WHEN own AND n % 4 = 3 THEN concat('"found ', n, '"') END AS result_b
  FROM b LEFT JOIN level ON b.conv_id = level.conv_id AND b.id = level.id),
e AS (SELECT *, CASE WHEN n % 4 = 0 THEN '$.limit: under minimum' ELSE '' END AS error_a,
  concat_ws('; ', CASE WHEN n % 3 = 1 THEN 'unknown tool: lookup' END, CASE WHEN NOT own THEN 'repeated id' END, CASE WHEN own AND lost THEN concat('needs unknown: ', need) WHEN own AND level IS NULL THEN 'cycle' END) AS error_b FROM f)
SELECT conv_id, n AS turn, 'assistant' AS role, CAST(2 AS BIGINT) AS n_calls, CAST(count(result_a) + count(result_b) AS BIGINT) AS n_linked, CAST(sum((error_a <> '')::INT + (error_b <> '')::INT) AS BIGINT) AS n_invalid, FALSE AS orphan,
  concat('{"content":', to_json(text), ',"role":"assistant","tool_calls":[{"arguments":{"limit":', n % 4, ',"query":', to_json(left(text, 20)), '},"error":"', error_a, '","id":"a', n, '","level":0,"name":"search","result":', coalesce(result_a, 'null'),
    '},{"arguments":{"expression":"x","uses":{"$ref":"', need, '"}},"error":"', error_b, '","id":"', id, '","level":', coalesce(CAST(level AS VARCHAR), 'null'), ',"name":"', CASE WHEN n % 3 = 1 THEN 'lookup' ELSE 'calculate' END, '","result":', coalesce(result_b, 'null'), '}]}') AS json
FROM e GROUP BY ALL
UNION ALL SELECT DISTINCT conv_id, n, 'tool', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), n % 4 = 1,
  concat('{"content":"found ', n, '","role":"tool","tool_call_id":"', CASE WHEN n % 2 = 0 THEN 'a' WHEN n % 4 = 3 THEN 'b' ELSE 'z' END, n, '"}') FROM e
UNION ALL SELECT conv_id, turn, role, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, concat('{"content":', to_json(coalesce(text, '')), ',"role":"', coalesce(role, ''), '"}') FROM t WHERE role IS DISTINCT FROM 'assistant'
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda i: CAST(concat('0x', substr(h, i, 8)) AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 : n], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN concat(substr(split_part(output, '<S>', 1), 4), split_part(output, '<M>', 2), split_part(split_part(output, '<S>', 2), '<M>', 1))
    ELSE concat(split_part(split_part(output, '<P>', 2), '<M>', 1), split_part(output, '<M>', 2), substr(split_part(output, '<P>', 1), 4)) END) AS restored_sha256
FROM o
"""

SQL = {"op11_fill_in_middle": FILL_IN_MIDDLE, "op5_chat_format": CHAT, "op2_licenses": LICENSES, "op6_embedding_dedup": EMBEDDINGS, "op8_decontamination": DECONTAMINATION, "op9_minhash": MINHASH}
