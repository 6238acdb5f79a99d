"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from firmscope.llm import licences as L

ORACLE: dict[str, str] = {}

ORACLE["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), TRUE)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id != q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op5_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list(doc_id) AS ids, len(sh) AS n, sh FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
x AS (SELECT rep, n, unnest(sh) AS g FROM c),
l AS (
  SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.v FROM reach r JOIN e ON e.u = r.b),
k AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a),
m AS (SELECT unnest(c.ids) AS doc_id, k.component FROM c JOIN k USING (rep))
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m USING (doc_id)
"""

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '')"""

ORACLE["op4_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS txt
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT doc_id, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS txt
  FROM (SELECT DISTINCT n FROM win) l, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x WHERE i + l.n - 1 <= len(w)),
o AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM p JOIN win ON p.txt = win.txt AND p.n = win.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE["op3_preference"] = """
WITH c AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max({'turn': turn, 'text': coalesce(text, '')}) AS last FROM c WHERE role = 'assistant' GROUP BY pair_id),
r AS (
  SELECT c.pair_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = l.last.turn THEN o.last.text ELSE c.text END AS text
  FROM c LEFT JOIN l ON l.pair_id = c.pair_id LEFT JOIN l o ON o.pair_id = xor(c.pair_id, 1)
  WHERE NOT coalesce(c.role = 'assistant' AND c.turn = l.last.turn, FALSE) OR o.pair_id IS NOT NULL),
t AS (
  SELECT DISTINCT 0 AS side, pair_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM c
  UNION SELECT 1, pair_id, turn, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |') FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
p AS (SELECT DISTINCT pair_id FROM t),
k AS (
  SELECT p.pair_id, coalesce(min(CASE WHEN a.role IS NULL OR b.role IS NULL OR a.role != b.role OR a.text != b.text THEN coalesce(a.i, b.i) END) - 1, max(coalesce(a.i, b.i))) AS k
  FROM p LEFT JOIN (SELECT * FROM n WHERE side = 0) a ON a.pair_id = p.pair_id
  FULL JOIN (SELECT * FROM n WHERE side = 1) b ON b.pair_id = a.pair_id AND b.i = a.i GROUP BY p.pair_id),
m AS (
  SELECT n.*, k.k, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM n JOIN k USING (pair_id)),
z AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m WHERE i > k),
s AS (
  SELECT pair_id, side, string_agg(head || body, '' ORDER BY i) AS txt,
    string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(off AS BIGINT) + length(head) AS VARCHAR) || ':' || CAST(CAST(off AS BIGINT) + length(head) + length(body) AS VARCHAR) END, ',' ORDER BY i) AS spans
  FROM z GROUP BY pair_id, side),
q AS (SELECT pair_id, string_agg(head || body, '' ORDER BY i) AS txt FROM m WHERE side = 0 AND i <= k GROUP BY pair_id)
SELECT k.pair_id, CAST(k.k AS INTEGER) AS n_common, coalesce(q.txt, '') AS prompt, coalesce(a.txt, '') AS chosen, coalesce(a.spans, '') AS chosen_spans,
  coalesce(b.txt, '') AS rejected, coalesce(b.spans, '') AS rejected_spans
FROM k LEFT JOIN q USING (pair_id) LEFT JOIN s a ON a.pair_id = k.pair_id AND a.side = 0 LEFT JOIN s b ON b.pair_id = k.pair_id AND b.side = 1
"""

ORACLE["op11_search"] = r"""
WITH c AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, NULL AS item, text FROM documents
  UNION ALL SELECT 'q', 0, NULL, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
t AS (
  SELECT kind, r, id, item, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x != '')) AS term FROM c),
f AS (SELECT r, id, term, count(*) AS tf FROM t WHERE kind = 'd' GROUP BY r, id, term),
d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS len FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
m AS (SELECT r, 100 - 90 + (90 * n * n_docs) // len AS m FROM d, s),
q AS (SELECT DISTINCT item, term FROM t WHERE kind = 'q'),
x AS (
  SELECT q.item AS item_id, f.r, f.id AS doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.r = f.r GROUP BY q.item, f.r, f.id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

ORACLE["op13_interaction"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
v AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM d),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS m
  FROM v LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM a p JOIN a q ON q.x != p.x JOIN a r ON r.x NOT IN (p.x, q.x)
  JOIN a s ON s.x NOT IN (p.x, q.x, r.x) JOIN a t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
z AS (
  SELECT g.*, o.o, i.step, o.o[i.step] AS letter, contains(m, o.o[i.step]) AS fails, length(translate(m, o.o[1:i.step - 1], '')) = length(m) AS reached
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) i),
y AS (
  SELECT part, o AS filter_order, step, letter, CAST(coalesce(sum(n) FILTER (WHERE fails AND reached), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE reached AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT reached), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE m = letter), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE fails AND reached), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE fails AND reached), 0) AS BIGINT) AS toxic_lost
  FROM z GROUP BY part, o, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y
"""


def _licence_sql() -> str:
    """The licence scan by joins: index words by document counts, agreeing places, key phrases, shares."""
    def text(x: str) -> str:
        return f"'{x}'"

    templates = ", ".join(f"({i}, {text(t.label)}, {text(t.text)})" for i, t in enumerate(L.TEMPLATES))
    keys = ", ".join(f"({i}, {len(t.text[: f' {t.text} '.index(f' {k} ')].split())}, {text(k)})" for i, t in enumerate(L.TEMPLATES) for k in t.keys)
    phrases = ", ".join(f"({text(p)}, {text(label)})" for p, label in L.PHRASES.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS MATERIALIZED (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
t AS (SELECT t, label, string_split(body, ' ') AS w FROM (VALUES {templates}) x(t, label, body)),
tp AS MATERIALIZED (SELECT t, unnest(range(len(w))) AS q, unnest(w) AS word FROM t),
held AS (SELECT word, count(DISTINCT r) AS n FROM p WHERE word IN (SELECT word FROM tp) GROUP BY word),
rare AS (
  SELECT t, word FROM (SELECT DISTINCT t, word, coalesce(n, 0) AS n FROM tp LEFT JOIN held USING (word))
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= greatest({L.INDEX_LEAST}, ceil({L.INDEX_SHARE} * count(*) OVER (PARTITION BY t)))),
idx AS MATERIALIZED (SELECT tp.t, q, word FROM tp JOIN rare USING (t, word)),
two AS (SELECT r FROM p WHERE word IN (SELECT word FROM idx) GROUP BY r HAVING count(DISTINCT word) >= 2),
v AS (SELECT r, t, i - q AS pos FROM p JOIN idx USING (word) JOIN two USING (r) GROUP BY r, t, i - q HAVING count(*) >= 2),
k AS (SELECT t, q, string_split(body, ' ') AS ph FROM (VALUES {keys}) x(t, q, body)),
ok AS (
  SELECT r, t, pos FROM v JOIN d USING (r) JOIN k USING (t)
  GROUP BY r, t, pos HAVING bool_and(list_contains(list_transform(range({-L.DRIFT}, {L.DRIFT} + 1), lambda s: pos + q + s >= 0 AND w[pos + q + s + 1:pos + q + s + len(ph)] = ph), true))),
own AS (
  SELECT r, t, pos, avg(CASE WHEN pos + q >= 0 AND d.w[pos + q + 1] = tp.word THEN 1.0 ELSE 0.0 END) AS share FROM ok JOIN d USING (r) JOIN tp USING (t) GROUP BY r, t, pos),
f AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM own JOIN t USING (t) GROUP BY r),
b AS (
  SELECT r, i, label FROM (SELECT string_split(body, ' ') AS ph, label FROM (VALUES {phrases}) x(body, label)) n JOIN p ON p.word = n.ph[1] JOIN d USING (r)
  WHERE d.w[i + 1:i + len(ph)] = ph),
g AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(g.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(g.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n > 0 THEN {L.NAMED} ELSE 0.0 END) AS score
FROM d LEFT JOIN f USING (r) LEFT JOIN g USING (r)
"""


ORACLE["op12_licences"] = _licence_sql()

#: Bytes as pairs of hexadecimal digits; every 50-byte string with the smallest document it starts in.
ORACLE["op9_suffix"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL AND len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS lowest FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT s.r, s.i FROM s JOIN f ON f.s = s.s WHERE f.lowest < s.doc_id),
e AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 50 AS opens FROM g),
n AS (SELECT r, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
u AS (SELECT r, run, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY r, run),
k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM u),
x AS (
  SELECT k.r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x ON x.r = d.r
"""

#: Counts of n-grams by language and by document, ranks, and sums of their differences; every row teaches
#: that is not held out, as the sample does while a language has no more rows than it takes.
ORACLE["op6_langid"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, text, %HELD% AS held_out FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM d),
c AS MATERIALIZED (SELECT r, word, count(*) AS n FROM w GROUP BY r, word),
g AS MATERIALIZED (
  SELECT r, gram, sum(n) AS n FROM (
    SELECT r, n, unnest(list_concat(
      list_transform(range(1, len(word) + 1), lambda i: word[i:i]),
      list_transform(range(1, len(word) + 2), lambda i: (' ' || word || ' ')[i:i + 1]),
      list_transform(range(1, len(word) + 1), lambda i: (' ' || word || ' ')[i:i + 2]))) AS gram FROM c) GROUP BY r, gram),
o AS (SELECT gram, coalesce(unicode(nullif(gram[3:3], '')), 0) AS x, coalesce(unicode(nullif(gram[2:2], '')), 0) AS y, unicode(gram[1:1]) AS z FROM (SELECT DISTINCT gram FROM g)),
e AS MATERIALIZED (SELECT gram, CASE WHEN x = 32 THEN 1 ELSE x END AS x, CASE WHEN y = 32 THEN 1 ELSE y END AS y, CASE WHEN z = 32 THEN 1 ELSE z END AS z FROM o),
p AS MATERIALIZED (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x, y, z) - 1 AS place FROM (
    SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram) JOIN e USING (gram) QUALIFY place < 300),
t AS MATERIALIZED (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, x, y, z) - 1 AS place FROM g JOIN e USING (gram) QUALIFY place < 300),
l AS (SELECT DISTINCT lang FROM p),
a AS (
  SELECT t.r, l.lang, sum(coalesce(abs(p.place - t.place), 300)) AS away, count(*) AS own FROM t CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.gram = t.gram GROUP BY t.r, l.lang),
b AS (SELECT r, arg_min(lang, {a: away, l: lang}) AS lang, min(away) AS away, any_value(own) AS own FROM a GROUP BY r)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1.0 - CAST(b.away AS DOUBLE) / (300 * b.own), 0.0) AS score FROM d LEFT JOIN b ON b.r = d.r
"""

#: crc32 of the id's digits, bit by bit, leaves the remainder of held-out rows.
_HELD_OUT = (
    "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), "
    "lambda crc, b: list_reduce(list_concat([xor(crc, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 = 2"
)
ORACLE["op6_langid"] = ORACLE["op6_langid"].replace("%HELD%", _HELD_OUT)
