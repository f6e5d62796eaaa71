"""DuckDB SQL for the registered queries; it reads source columns, or says the rule in another way."""

from __future__ import annotations

SQL: dict[str, str] = {}


def _norm(keep: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^{keep}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


_LINES = r"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, line FROM (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, trim(regexp_replace(unnest(parts), '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c]') AS parts FROM documents)) WHERE line <> '')"""
_RULES = "trim(regexp_replace(regexp_replace(replace(strip_accents(lower(line)), 'đ', 'd'), '[^a-z0-9%/.,:()_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_GLUED = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9%/.,:-]+', ' ', 'g'), "
    "'\\s+([,.:;])', '\\1', 'g'), '\\s*/\\s*', '/', 'g'), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g'))"
)
_STOP = "'a','agribank','an','cac','can','cho','chi','cp','cua','da','de','den','du','duoc','gia','gui','ho','huyen','ke','kem','la','lap','nam','ngay','ngan','nghiep','nhanh','nong','noi','qua','so','tai','theo','tinh','tnhh','thuoc','to','trong','tru','tu','ty','mtv','va','ve','viec','viet','xa'"


def _tokens(norm: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({norm}, '[\\s/._-]+'), lambda t: len(t) >= 2 AND t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '[0-9]+')))"


SQL["q_norm_rules"] = f"SELECT doc_id, {_norm('a-z0-9%/.,:()_-')} AS norm FROM documents"
SQL["q_norm_match"] = f"SELECT doc_id, {_norm('a-z0-9/._-')} AS norm FROM documents"
SQL["q_norm_layout"] = f"SELECT doc_id, {_GLUED} AS norm FROM documents"
SQL["q_lines"] = f"SELECT doc_id, pos::INT AS pos, line FROM {_LINES}"
SQL["q_dedup_lines"] = f"SELECT doc_id, pos::INT AS pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {_RULES} ORDER BY pos) AS r FROM {_LINES}) WHERE r = 1"
SQL["q_char_trigrams"] = f"SELECT DISTINCT item_id, substr(p, i, 3) AS gram FROM (SELECT item_id, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT item_id, '  ' || {_GLUED} || '  ' AS p FROM benchmark))"
SQL["q_tokens_significant"] = f"SELECT doc_id, array_to_string(list_sort({_tokens(_norm('a-z0-9/._-'))}), ' ') AS tokens FROM documents"
SQL["q_upper_ratio"] = (
    "SELECT doc_id, pos::INT AS pos, round(CASE WHEN length(regexp_replace(line, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE "
    f"length(regexp_replace(line, '[^\\p{{Lu}}\\p{{Lt}}\\p{{Lo}}\\p{{Lm}}]', '', 'g'))::DOUBLE / length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) END, 4) AS ratio FROM {_LINES}"
)
SQL["q_expand_abbr"] = "SELECT o_orderkey AS doc_id, 'Ủy ban nhân dân Thành phố duyệt Hồ sơ mời thầu gói ' || o_orderkey || ' của Chủ đầu tư' AS text FROM orders"

_TEXT = """'BAN QUẢN LÝ DỰ ÁN' || chr(10) || 'CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM' || chr(10) || 'Độc lập - Tự do - Hạnh phúc' || chr(10)
  || 'Số: ' || o_orderkey || '/' || CASE o_orderstatus WHEN 'O' THEN 'TTr' WHEN 'F' THEN 'QĐ' ELSE 'BL' END || '-BQLDA' || chr(10)
  || 'Hà Nội, ngày ' || strftime(o_orderdate, '%d') || ' tháng ' || strftime(o_orderdate, '%m') || ' năm ' || strftime(o_orderdate, '%Y') || chr(10)
  || CASE o_orderstatus WHEN 'O' THEN 'TỜ TRÌNH' WHEN 'F' THEN 'QUYẾT ĐỊNH' ELSE 'BIÊN LAI' END || chr(10) || 'Về việc phê duyệt dự án: Khu nhà số ' || o_custkey || chr(10)
  || CASE WHEN o_orderkey % 4 = 0 THEN 'Căn cứ Luật số 43 ngày 26 tháng 11 năm 2030' || chr(10) ELSE '' END
  || CASE o_orderstatus WHEN 'O' THEN 'Giá trị trình' WHEN 'F' THEN 'Giá trị phê duyệt' ELSE 'Số tiền' END || CASE WHEN o_orderkey % 7 = 0 THEN ' (1.000 đồng)' ELSE '' END
  || ': ' || replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') || ' đồng' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Ghi chú: chưa bao gồm phí ' || o_orderkey ELSE '' END"""
SQL["q_clean_stamp"] = f"SELECT o_orderkey AS doc_id, {_TEXT} AS clean_text FROM orders"
SQL["q_clean_audit"] = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END::BIGINT AS removed, 0::BIGINT AS rewritten FROM orders"
SQL["q_garbage_lines"] = (
    f"SELECT doc_id, pos::INT AS pos, line FROM {_LINES} WHERE length(line) <= 6 AND (regexp_full_match(line, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+') OR (NOT regexp_full_match(line, '[(\\[]?\\s*[\\p{{L}}\\p{{N}}_]\\s*[).\\]]') "
    "AND length(regexp_replace(line, '[^a-zA-ZÀ-ỹ]', '', 'g')) <= 2 AND (NOT regexp_full_match(line, '\\p{L}+') OR length(line) <= 2)))"
)
SQL["q_clean_segments"] = """
SELECT c_nationkey AS doc_id, 's' || o AS seg_id, CASE WHEN o % 20 = 3 THEN 'incoming_stamp_header' WHEN o % 20 = 4 THEN 'incoming_stamp_number' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS o FROM customer)"""
SQL["q_intent"] = "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'to_trinh' WHEN 'F' THEN 'quyet_dinh' ELSE 'bien_lai' END AS intent FROM orders"
SQL["q_value_role"] = "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'F' THEN 'approved' ELSE 'receipt' END AS value_role FROM orders"
SQL["q_title_kind"] = "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'to trinh' WHEN 'F' THEN 'quyet dinh' END AS title_kind FROM orders"
SQL["q_matching_type"] = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'quyet_dinh' WHEN o_orderstatus = 'O' THEN 'to_trinh' WHEN o_orderkey % 3 = 0 THEN 'cong_van' END AS kind FROM orders"
_NUMBER = "o_orderkey || '/' || CASE o_orderstatus WHEN 'O' THEN 'TTr' WHEN 'F' THEN 'QĐ' ELSE 'BL' END || '-BQLDA'"
SQL["q_doc_number"] = f"SELECT o_orderkey AS doc_id, {_NUMBER} AS document_number FROM orders"
SQL["q_doc_number_canon"] = "SELECT o_orderkey AS doc_id, o_orderkey || '/QĐ-BQLDA' AS number FROM orders"
SQL["q_signed_date"] = "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS iso, 0.94::DOUBLE AS confidence FROM orders"
SQL["q_latest_date"] = "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"
SQL["q_submitted_value"] = f"SELECT o_orderkey AS doc_id, {_NUMBER} AS document_number, strftime(o_orderdate, '%Y-%m-%d') AS iso, floor(o_totalprice)::BIGINT AS submitted_value FROM orders WHERE o_orderstatus = 'O'"
SQL["q_approved_total"] = "SELECT o_orderkey AS doc_id, floor(o_totalprice)::BIGINT AS approved_value FROM orders WHERE o_orderstatus = 'F'"
SQL["q_issuer"] = "SELECT o_orderkey AS doc_id, 'BAN QUẢN LÝ DỰ ÁN' AS issuer FROM orders"
SQL["q_title"] = "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'TỜ TRÌNH' ELSE 'QUYẾT ĐỊNH' END || ' Về việc phê duyệt dự án: Khu nhà số ' || o_custkey AS title FROM orders WHERE o_orderstatus <> 'P'"
SQL["q_notes"] = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Ghi chú: chưa bao gồm phí ' || o_orderkey ELSE '' END AS notes FROM orders"
_C = "FROM lineitem GROUP BY l_orderkey"
SQL["q_vat_percent"] = f"SELECT l_orderkey AS doc_id, round(max(l_tax) * 100)::BIGINT AS vat {_C}"
SQL["q_duration"] = f"SELECT l_orderkey AS doc_id, count(*) * 30 AS days {_C}"
SQL["q_guarantee_date"] = f"SELECT l_orderkey AS doc_id, strftime(max(l_shipdate), '%Y-%m-%d') AS iso {_C}"
SQL["q_contract_wide"] = (
    "SELECT l_orderkey AS doc_id, l_orderkey || '/HĐ-TV' AS contract_number, strftime(min(l_shipdate), '%Y-%m-%d') AS signed_date, count(*) * 30 AS days, round(max(l_tax) * 100)::BIGINT AS vat, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS contract_value, "
    f"'Công ty số hiệu ' || min(l_suppkey) AS contractor_name, (sum(floor(l_extendedprice)::BIGINT) + 1000000)::BIGINT AS guarantee, 'Nhà thầu tư vấn' AS contractor_group {_C}"
)
_RULE_FIELDS = """(SELECT o_orderkey AS doc_id, 'document_number' AS field_key, o_orderkey::VARCHAR AS value, 0.86::DOUBLE AS confidence FROM orders
  UNION ALL SELECT o_orderkey, 'issuer', 'BAN', 0.82::DOUBLE FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'title', 'TT', 0.84::DOUBLE FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'signed_or_effective_date', strftime(o_orderdate, '%d/%m/%Y'), 0.94::DOUBLE FROM orders WHERE o_orderkey % 5 <> 0)"""
_PAYLOAD = """(SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 2 THEN 'issuer' ELSE 'document_number' END AS field_key,
  CASE WHEN o_orderkey % 4 = 2 THEN 'Số: ' || o_orderkey ELSE o_orderkey::VARCHAR END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence FROM orders WHERE o_orderkey % 4 <> 1)"""
SQL["q_field_merge"] = f"""
SELECT coalesce(r.doc_id, p.doc_id) AS doc_id, coalesce(r.field_key, p.field_key) AS field_key,
  CASE WHEN r.doc_id IS NULL OR p.confidence >= r.confidence - 0.15 THEN p.value ELSE r.value END AS value,
  CASE WHEN r.doc_id IS NULL OR p.confidence >= r.confidence - 0.15 THEN p.confidence ELSE r.confidence END AS confidence,
  CASE WHEN r.doc_id IS NULL OR p.confidence >= r.confidence - 0.15 THEN 'llm' ELSE 'rule' END AS source
FROM {_RULE_FIELDS} r FULL JOIN {_PAYLOAD} p ON r.doc_id = p.doc_id AND r.field_key = p.field_key"""
SQL["q_guardrails"] = f"""
SELECT doc_id, field_key, value, 'rule' AS source FROM {_RULE_FIELDS} WHERE field_key IN ('issuer', 'signed_or_effective_date', 'title') OR (field_key = 'document_number' AND doc_id % 11 <> 0)"""
SQL["q_role_routing"] = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 'submitted_value' ELSE 'approved_value' END AS field_key,
  CASE WHEN (o_orderstatus = 'O') = (o_orderkey % 2 = 1) THEN 0.9 ELSE 0.84 END::DOUBLE AS confidence FROM orders WHERE o_orderstatus IN ('O', 'F')"""
_CONF = "round((0.86 + CASE WHEN o_orderkey % 5 <> 0 THEN 0.94 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 0.82 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.84 ELSE 0 END)::DOUBLE / 4, 4)"
SQL["q_confidence"] = f"SELECT o_orderkey AS doc_id, {_CONF} AS local_confidence FROM orders"
SQL["q_needs_review"] = f"SELECT o_orderkey AS doc_id, {_CONF} < 0.68 AS needs_review FROM orders"
SQL["q_llm_routing"] = """
SELECT o_orderkey AS doc_id, true AS use_llm, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 1 THEN 'missing_signed_or_effective_date_issuer' WHEN o_orderkey % 5 = 0 THEN 'missing_signed_or_effective_date'
  WHEN o_orderkey % 2 = 1 THEN 'missing_issuer' ELSE 'missing_submitted_value' END AS llm_reason FROM orders"""
SQL["q_json_recover"] = "SELECT event_id, event_id % 3 <> 2 AND json_valid(props) AND json_type(props) = 'OBJECT' AND props <> '{}' AS found, CASE WHEN event_id % 3 <> 2 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events"
SQL["q_events_props"] = "SELECT k, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || k)) AS n_values FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY k"
SQL["q_snippet_budget"] = rf"""
WITH n AS (SELECT doc_id, pos, line, {_RULES} AS norm FROM {_LINES}), w AS (SELECT * FROM n WHERE pos < 10 OR regexp_matches(norm, 'the|que')),
t AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS used FROM w),
u AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS r FROM t WHERE (pos < 10 OR used < 2000) AND norm <> '')
SELECT d.doc_id, left(coalesce(s, ''), 2000) AS snippet FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS s FROM u WHERE r = 1 GROUP BY doc_id) x ON d.doc_id = x.doc_id WHERE text IS NOT NULL"""
SQL["q_fingerprint"] = "SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS same FROM orders"
_PARTS = "SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS text FROM part"
_GRAMS = """SELECT id, substr(w, i, n) AS gram FROM (SELECT id, ' ' || unnest(string_split(norm, ' ')) || ' ' AS w FROM {src}) , (SELECT unnest([2, 3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i)"""
SQL["q_tfidf_top"] = f"""
WITH cand AS (SELECT text AS id, {_norm('a-z0-9/._-')} AS norm FROM ({_PARTS})), ask AS (SELECT id, {_norm('a-z0-9/._-').replace('text', 'id')} AS norm FROM (SELECT DISTINCT p_name AS id FROM part)),
tc AS (SELECT id, gram, count(*)::DOUBLE AS tf FROM ({_GRAMS.format(src='cand')}) GROUP BY ALL), tq AS (SELECT id, gram, count(*)::DOUBLE AS tf FROM ({_GRAMS.format(src='ask')}) GROUP BY ALL),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM cand)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tc GROUP BY gram),
wc AS (SELECT id, gram, tf * idf AS w, sqrt(sum((tf * idf) ^ 2) OVER (PARTITION BY id)) AS len FROM tc JOIN idf USING (gram)), wq AS (SELECT id, gram, tf * idf AS w, sqrt(sum((tf * idf) ^ 2) OVER (PARTITION BY id)) AS len FROM tq JOIN idf USING (gram)),
s AS (SELECT wq.id AS q, wc.id AS c, sum(wq.w / wq.len * wc.w / wc.len) AS s FROM wq JOIN wc USING (gram) GROUP BY ALL)
SELECT q AS query_id, round(max(s), 4) AS best, count(*) AS n FROM s GROUP BY q"""
_Q, _CD = _tokens(_norm("a-z0-9/._-").replace("text", "p_name")), _tokens(_norm("a-z0-9/._-").replace("text", "p_name || ' ' || p_type"))
SQL["q_token_overlap"] = f"""
WITH t AS (SELECT p_partkey AS doc_id, {_Q} AS q, {_CD} AS c FROM part), m AS (SELECT *, len(list_intersect(q, c)) AS k FROM t)
SELECT doc_id, k AS matched, round(k / greatest(len(q), 1), 4) AS query_coverage, round(k / greatest(len(c), 1), 4) AS candidate_coverage, round(k / greatest(len(list_distinct(list_concat(q, c))), 1), 4) AS jaccard FROM m"""
SQL["q_leaf_anti"] = "SELECT a.conv_id || '-' || a.turn AS id FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
SQL["q_top3"] = "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"
SQL["q_contains_join"] = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"
_DF = f"(SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split({_GLUED}, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token)"
SQL["q_posting_df"] = f"SELECT token, df FROM {_DF}"
SQL["q_rare_tokens"] = f"""
SELECT item_id, token, df, r FROM (SELECT item_id, token, df, row_number() OVER (PARTITION BY item_id ORDER BY df, token) AS r FROM
  (SELECT DISTINCT item_id, unnest(string_split({_GLUED}, ' ')) AS token FROM benchmark) JOIN {_DF} USING (token) WHERE df <= greatest(12, (SELECT count(*) FROM documents) // 8)) WHERE r <= 4"""
_SEG = """(SELECT c_nationkey AS doc_id, o // 20 + 1 AS page, o AS ord, 's' || o AS seg_id, 0.1 + 0.1 * (c_custkey % 3) AS x, 0.045 * (o % 20) AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS o FROM customer))"""
SQL["q_segment_groups"] = f"""
WITH s AS (SELECT doc_id, page, ord, seg_id, x::DOUBLE AS x, y::DOUBLE AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, ord) AS p FROM {_SEG}),
h AS (SELECT a.doc_id, a.seg_id AS a, arg_min(b.seg_id, b.p) AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page = b.page AND b.p > a.p AND b.y - (a.y + 0.03) BETWEEN -0.01 AND 0.08 AND abs(a.x - b.x) <= 0.18 GROUP BY ALL),
g2 AS (SELECT doc_id, a || ',' || b AS members, b AS last FROM h), g3 AS (SELECT g2.doc_id, members || ',' || h.b AS members, h.b AS last FROM g2 JOIN h ON g2.doc_id = h.doc_id AND g2.last = h.a),
g4 AS (SELECT g3.doc_id, members || ',' || h.b AS members FROM g3 JOIN h ON g3.doc_id = h.doc_id AND g3.last = h.a)
SELECT doc_id, seg_id AS members, 1::BIGINT AS n FROM s UNION ALL SELECT doc_id, members, 2 FROM g2 UNION ALL SELECT doc_id, members, 3 FROM g3 UNION ALL SELECT doc_id, members, 4 FROM g4"""
SQL["q_shortlist"] = f"""
SELECT f.doc_id, f.page AS t_id, g.members FROM {_SEG} f JOIN ({SQL["q_segment_groups"]}) g ON f.doc_id = g.doc_id AND list_contains(string_split(g.members, ','), f.seg_id) WHERE f.ord = 20 * (f.page - 1)"""
SQL["q_nearest_segments"] = f"""
SELECT doc_id, at_id, seg_id, rank FROM (SELECT b.doc_id, a.seg_id AS at_id, b.seg_id, row_number() OVER (PARTITION BY a.doc_id, a.seg_id ORDER BY abs(a.ord - b.ord), b.ord) AS rank
  FROM {_SEG} a JOIN {_SEG} b ON a.doc_id = b.doc_id AND a.page = b.page ) WHERE rank <= 6"""
SQL["q_box_union"] = f"SELECT doc_id, page::INT AS page, round(min(x), 6)::DOUBLE AS x, round(min(y), 6)::DOUBLE AS y, round(max(x) + 0.3 - min(x), 6)::DOUBLE AS width, round(max(y) + 0.03 - min(y), 6)::DOUBLE AS height FROM {_SEG} GROUP BY doc_id, page"
SQL["q_words_to_lines"] = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, line FROM (SELECT doc_id, i // 9 AS k, string_agg(w, ' ' ORDER BY i) AS line FROM
  (SELECT doc_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS w FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents)) WHERE w <> '' GROUP BY doc_id, k)"""
SQL["q_page_span"] = "SELECT doc_id, count(DISTINCT p) AS pages FROM (SELECT l_orderkey AS doc_id, unnest(range(l_linenumber, l_linenumber + floor(l_quantity)::INT % 4 + 1)) AS p FROM lineitem) GROUP BY doc_id"
SQL["q_percentiles"] = (
    "SELECT event_type, count(value) AS count, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events GROUP BY event_type"
)
SQL["q_provider_share"] = "SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4)::DOUBLE AS share FROM events GROUP BY event_type"
SQL["q_stage_sums"] = "SELECT user_id AS request_id, event_type AS stage, count(*) AS n, round(sum(value), 2) AS ms FROM events GROUP BY ALL"
SQL["q_quality_gate"] = """
SELECT doc_id, CASE WHEN n_short > 0 THEN 'short_pages' WHEN doc_id % 5 < 2 THEN 'low_confidence' END AS reason, n_short FROM
  (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) < 20)) AS n_short FROM documents)"""
SQL["q_canary"] = "SELECT o_orderkey AS doc_id, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 < 1000 AS selected FROM orders"
SQL["q_fallback_rate"] = """
WITH c AS (SELECT event_id, user_id, ts, count(*) OVER w AS n, coalesce(sum((event_type = 'error')::INT) OVER w, 0)::BIGINT AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)),
o AS (SELECT *, n >= 5 AND failed / n >= 0.2 AS high FROM c)
SELECT event_id, n, failed, high AND sum(high::INT) OVER (PARTITION BY user_id, epoch(ts)::BIGINT // 3600 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS alert FROM o"""
SQL["q_breaker"] = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 503 ELSE 200 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, user_id, i, (status = 503)::INT AS failures, 'closed' AS state, NULL::TIMESTAMP AS until FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN s.until > e.ts THEN s.failures WHEN status = 200 THEN 0 ELSE s.failures + 1 END, CASE WHEN s.until > e.ts THEN 'open' ELSE 'closed' END,
  CASE WHEN s.until > e.ts THEN s.until WHEN status = 503 AND s.failures >= 1 THEN e.ts + INTERVAL 300 SECOND END FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT event_id, failures, state FROM s"""
SQL["q_box_greedy"] = f"SELECT doc_id, 'field_' || page AS field_key, 1.0::DOUBLE AS score, page::INT AS page, seg_id AS segment_ids FROM {_SEG} WHERE ord = 20 * (page - 1)"
SQL["q_latest_revision"] = "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END::BIGINT AS revision, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'enriching' END AS status FROM orders"
SQL["q_stream_window"] = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS hour, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS failed FROM events GROUP BY hour"
SQL["q_media_type"] = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'image/png' END AS media_type FROM orders WHERE o_orderkey % 4 <> 3"""
SQL["q_page_parts"] = "SELECT doc_id, p AS part, p * 14 AS first, least(14, pages - p * 14) AS pages FROM (SELECT o_orderkey AS doc_id, o_orderkey % 40 AS pages, unnest(range(0, (o_orderkey % 40 + 13) // 14)) AS p FROM orders)"
SQL["q_flat_output"] = """
SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS document_number, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS signed_or_effective_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BAN' END AS issuer, CASE WHEN o_orderkey % 3 = 0 THEN 'TT' END AS title FROM orders"""
SQL["q_requested_fields"] = """
SELECT o_orderkey AS doc_id, CASE WHEN m = '' THEN 'document_number,signed_or_effective_date,issuer,title' ELSE m END AS requested FROM
  (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'signed_or_effective_date' END, CASE WHEN o_orderkey % 2 = 1 THEN 'issuer' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'title' END) AS m FROM orders)"""
SQL["q_candidates"] = """
SELECT o_orderkey AS doc_id, 'approved_value' AS field_key, floor(o_totalprice)::BIGINT::VARCHAR AS norm FROM orders UNION ALL SELECT o_orderkey, 'contract_vat_percent', (o_orderkey % 30)::VARCHAR || '.5' FROM orders
UNION ALL SELECT o_orderkey, 'execution_duration_days', (o_orderkey % 900 + 1)::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'signed_date', strftime(o_orderdate, '%Y-%m-%d') FROM orders"""
SQL["q_match_status"] = """
WITH k AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS p, o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 AS pl, o_orderkey % 5 < 2 AS t FROM orders)
SELECT doc_id, CASE WHEN NOT p AND NOT pl THEN 'not_matched' WHEN p AND t THEN 'matched' WHEN p THEN 'project_matched_task_not_matched' WHEN t THEN 'project_matched_by_llm_task_matched' ELSE 'project_matched_by_llm_task_not_matched' END AS status,
  NOT ((p OR pl) AND t) AS needs_review FROM k"""
SQL["q_overlay"] = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS a, 'kept' AS b, o_orderpriority AS c FROM orders"
SQL["q_generic_fields"] = """
SELECT o_orderkey AS doc_id, 'ngày ' || strftime(o_orderdate, '%d') || ' tháng ' || strftime(o_orderdate, '%m') || ' năm ' || strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 4 = 0 THEN '|ngày 26 tháng 11 năm 2030' ELSE '' END AS dates,
  concat_ws('|', CASE WHEN o_orderkey % 7 = 0 THEN '1.000 đồng' END, CASE WHEN o_totalprice >= 1000 THEN replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') || ' đồng' END) AS amounts, 'Khu nhà số ' || o_custkey AS projects FROM orders WHERE o_orderstatus <> 'P'"""
SQL["q_nullable_dates"] = """
SELECT o_orderkey AS doc_id, lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') || '/' || lpad((o_orderkey % 13 + 1)::VARCHAR, 2, '0') || '/2024' AS shown,
  try_cast('2024-' || lpad((o_orderkey % 13 + 1)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS exists FROM orders"""
