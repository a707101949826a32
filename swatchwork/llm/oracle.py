"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from swatchwork.llm import licenses, urlrules

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _license_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in licenses.SENTENCES.items())
    steps, line = [], "line0"
    for k, (_, seq) in enumerate(licenses.RULES):
        wanted = "|" + "||".join(seq) + "|"
        steps.append(f"s{k + 1} AS (SELECT *, contains(line{k}, '{wanted}') AS hit{k}, replace(line{k}, '{wanted}', '|#|') AS line{k + 1} FROM s{k})")
        line = f"s{k + 1}"
    names = ", ".join(f"CASE WHEN hit{k} THEN '{name}' END" for k, (name, _) in enumerate(licenses.RULES))
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
parts AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS raw FROM (
  SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\n\\r]+|[.!?;:]+[ \\t]+') AS p FROM documents)),
clean AS (SELECT doc_id, i, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM parts),
ids AS (SELECT doc_id, i, coalesce(name, '?') AS name FROM clean LEFT JOIN known USING (sentence) WHERE sentence <> ''),
s0 AS (SELECT doc_id, count(*) FILTER (name <> '?') AS n_known, coalesce(string_agg(name, ',' ORDER BY i) FILTER (name <> '?'), '') AS identifiers,
  '|' || string_agg(name, '||' ORDER BY i) || '|' AS line0 FROM ids GROUP BY doc_id),
{", ".join(steps)},
named AS (SELECT doc_id, n_known, identifiers, list_filter([{names}], lambda x: x IS NOT NULL) AS l FROM {line})
SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(identifiers, '') AS identifiers, coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') AS licenses
FROM documents d LEFT JOIN named USING (doc_id)"""


_QUALITY = r"""
WITH params AS (SELECT 20 AS least_docs),
w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
win AS (SELECT doc_id, i, count(*) OVER v = 8 AS whole, string_agg(word, ' ') OVER v AS win FROM pos WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT doc_id, i, whole AND count(*) OVER (PARTITION BY doc_id, whole, win) > 1 AS again FROM win),
covered AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM w),
held AS (SELECT doc_id, source, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM line),
held2 AS (SELECT * FROM held WHERE len(words) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM held2 GROUP BY doc_id),
norm AS (SELECT doc_id, source, text, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, len(words) AS n FROM held2),
often AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT (doc_id, text)) AS n FROM norm GROUP BY source, line), params WHERE n > least_docs),
lost AS (SELECT doc_id, sum(n) AS lost FROM norm JOIN often USING (source, line) GROUP BY doc_id),
base AS (SELECT doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM w)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, failed AS base_failed, NOT failed AND n_left >= 20 AND n_left >= 0.3 * n_words AS kept, n_left::BIGINT AS n_left_words
FROM (SELECT *, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS failed, n_words - coalesce(lost, 0) AS n_left
  FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON r.other = e.x),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN part USING (doc_id)"""

_LEAKS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2), lambda i: array_to_string(words[i:i + least(len(words), 10) - 1], ' '))) AS win FROM bw WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (SELECT doc_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: {i: i, w: array_to_string(words[i:i + size - 1], ' ')})) AS d FROM dw, sizes WHERE len(words) >= size),
hit AS (SELECT doc_id, d.i AS i, dwin.size AS size, item_id FROM dwin JOIN win ON dwin.d.w = win.win AND dwin.size = win.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_URLS = r"""
WITH rules(host, path, verdict) AS (VALUES {rules}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
fits AS (SELECT page_id, u.host, u.path, rules.host || rules.path AS rule, verdict FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)),
best AS (SELECT page_id, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule, verdict) = 1)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)"""

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn >') + length(role) + n + length('</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_TRIE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
byte_ AS (SELECT conv_id, list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
  xor(list_reduce(steps, lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM byte_),
head AS (SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h),
k AS (SELECT conv_id, count(*) AS k FROM head GROUP BY conv_id),
own AS (SELECT conv_id, t.pos - c.h + coalesce(k.k, 0) AS d, role, text FROM c JOIN t USING (conv_id) LEFT JOIN k USING (conv_id) WHERE t.pos > c.h),
whole AS (SELECT * FROM head UNION ALL SELECT * FROM own),
path AS (SELECT conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM whole
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM path),
node AS (SELECT d, node, any_value(parent) AS parent, count(*) AS n_convs, min(conv_id) AS conv_id, any_value(n_words) AS n_words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM up GROUP BY d, node),
child AS (SELECT parent, count(*) AS n_children FROM node WHERE d > 0 GROUP BY parent),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON child.parent = node.node),
below AS (SELECT p.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.n_words)::BIGINT AS saved_tokens FROM full_ f JOIN path p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.node)
SELECT f.conv_id, f.d AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_ f JOIN below USING (node) LEFT JOIN node a ON a.node = f.parent"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
-- Sources reach their cap in this order; the first that does not, with all before it capped, tells the level.
w AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS nth, coalesce(sum(3 * source_size) OVER before_, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before_, 0) AS free, sum(source_size) OVER () AS total
  FROM s WINDOW before_ AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((total - capped)::DOUBLE / free, nth) FILTER (3 * source_size >= (total - capped)::DOUBLE / free * weight) AS level FROM w),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM s, level),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (SELECT d.*, source_size, target, times, target - times * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN upto <= rest OR upto - size < rest AND 2 * rest > (2 * upto - size)::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op4_line_quality": _QUALITY,
    "op5_minhash_near_dup": _NEAR,
    "op6_url_rules": _URLS.replace("{rules}", ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlrules.RULES)),
    "op8_decontamination": _LEAKS,
    "op9_chat_format": _CHAT,
    "op11_prefix_trie": _TRIE,
    "op13_source_mix": _MIX,
}
