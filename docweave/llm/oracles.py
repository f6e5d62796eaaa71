"""DuckDB SQL for the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op7_url_cascade"] = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN ('.' || host) LIKE '%.spam-farm.example.org' OR ('.' || host) LIKE '%.casino-win.example.org' OR ('.' || host) LIKE '%.cheap-pills.example.com' THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

SQL["op4_chat_windows"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(regexp_replace(regexp_replace(text, '[A-Za-z0-9_]+', 'x', 'g'), '\s+', '', 'g')) + 4 AS tokens,
  length('<|turn|>') + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + 1 + length({_ESCAPED.format("text")}) + length('<|end|>') AS chars,
  row_number() OVER w AS ord FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY ord) - tokens AS before, max(tokens) OVER (PARTITION BY conv_id) AS longest,
  first(role) OVER (PARTITION BY conv_id ORDER BY ord) AS r1, first(tokens) OVER (PARTITION BY conv_id ORDER BY ord) AS t1, first(chars) OVER (PARTITION BY conv_id ORDER BY ord) AS c1 FROM n),
d AS (SELECT *, 2048 - 256 - CASE WHEN r1 = 'system' THEN t1 ELSE 0 END AS room FROM s),
v AS (SELECT *, before // greatest(room - longest, room // 2, 256) AS win FROM d),
own AS (SELECT conv_id, win, min(before) AS opens, sum(chars) + max(CASE WHEN r1 = 'system' AND win > 0 THEN c1 ELSE 0 END) AS chars FROM v GROUP BY ALL),
h AS (SELECT own.conv_id, own.win, sum(v.chars) AS chars FROM own JOIN v ON own.conv_id IS NOT DISTINCT FROM v.conv_id AND v.before < own.opens AND own.opens - v.before <= 256 AND NOT (ord = 1 AND role = 'system') GROUP BY ALL),
f AS (SELECT own.conv_id, sum(own.chars + coalesce(h.chars, 0)) AS formatted_chars FROM own LEFT JOIN h ON own.conv_id IS NOT DISTINCT FROM h.conv_id AND own.win = h.win GROUP BY ALL),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord) AS said,
  coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '') AS loss FROM n GROUP BY conv_id)
SELECT g.conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id
"""

_LISTS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine", "en": "the of and to in a is that for it as was with be by on not are",
    "es": "de la que el en y a los del se las por un para con no una su", "fr": "de la le et les des en un du une que est pour qui dans par pas au",
}
_LIST = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v.split())}]" for k, v in _LISTS.items()) + " END"


def _jsd(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of counts, base 2; null where either sums to nothing."""
    share = lambda a, i: f"({a}[{i}]::DOUBLE / list_sum({a}))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    terms = " + ".join(f"({part(share(p, i), share(q, i))} + {part(share(q, i), share(p, i))}) / 2" for i in range(1, n + 1))
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({terms}, 0)) END"


def _reference(source: str) -> str:
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])::BIGINT" for i in range(1, n + 1)) + "]"
    return f"SELECT lang, {sums('classes', 6)} AS rc, {sums('common', 19)} AS rw, {sums('forms', 4)} AS rf FROM {source} WHERE NOT base_failed GROUP BY lang"


SQL["op2_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY r),
f AS (SELECT t.r, doc_id, lang, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words, length(x) AS c, length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS c1, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS c2, length(x) - length(regexp_replace(x, '[0-9]', '', 'g')) AS c3,
  length(x) - length(regexp_replace(x, '[.,;:!?''"()\-]', '', 'g')) AS c4, len(list_filter(w, lambda s: regexp_matches(s, '[#*$%&|<>]'))) AS s1, len(list_filter(w, lambda s: regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '[#*$%&|<>]'))) AS s2,
  len(list_filter(w, lambda s: regexp_matches(s, '\p{{Lu}}[^\p{{Ll}}]*\p{{Lu}}') AND NOT regexp_matches(s, '[#*$%&|<>0-9]|\p{{Ll}}'))) AS s3, list_transform({_LIST}, lambda k: len(list_filter(w, lambda s: s = k))) AS hits FROM t LEFT JOIN rep ON t.r = rep.r),
g AS (SELECT *, [c1, c2 - c1, c3, c4, c - word_chars, c - c2 - c3 - c4 - (c - word_chars)] AS classes, list_append(hits, n_words - list_sum(hits)::BIGINT) AS common, [s1, s2, s3, n_words - s1 - s2 - s3] AS forms, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
r1 AS ({_reference('g')}), j1 AS (SELECT g.*, {_jsd('classes', 'rc', 6)} AS cj, {_jsd('forms', 'rf', 4)} AS fj, {_jsd('common', 'rw', 19)} AS wj FROM g LEFT JOIN r1 ON g.lang IS NOT DISTINCT FROM r1.lang),
r2 AS ({_reference('(SELECT * FROM j1 WHERE cj <= 0.3 AND fj <= sqrt(0.1) AND coalesce(wj, 0) <= sqrt(0.12))')}), j2 AS (SELECT g.*, {_jsd('classes', 'rc', 6)} AS cj, {_jsd('forms', 'rf', 4)} AS fj, {_jsd('common', 'rw', 19)} AS wj FROM g LEFT JOIN r2 ON g.lang IS NOT DISTINCT FROM r2.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((c >= 200 AND cj > 0.3) OR (n_words >= 20 AND fj > sqrt(0.1)) OR (n_words >= 100 AND wj > sqrt(0.12)), false) AS kept FROM j2
"""

SQL["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b, vec_id AS id FROM v UNION SELECT reach.a, l.b, l.id FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(id) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON v.r = c.a LEFT JOIN n ON v.r = n.a
"""
