"""DuckDB SQL with the results of the workspace queries."""

from __future__ import annotations

from parlance.functions.text import ROMAN, SECTION_WORDS, VIETNAMESE_ONLY, VIETNAMESE_WIDE


def _cur(name: str) -> str:
    return f"(SELECT * EXCLUDE nth_ FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS nth_ FROM {name} WHERE id IS NOT NULL) WHERE nth_ = 1)"


M, S, FL = _cur("messages"), _cur("sessions"), _cur("files")
HOT = f"(SELECT * FROM {M} WHERE session_id = (SELECT session_id FROM messages GROUP BY 1 ORDER BY count(*) DESC, session_id NULLS FIRST LIMIT 1))"
ORDERED = f"(SELECT *, row_number() OVER w AS position, lag(id) OVER w AS prev_id, lag(role) OVER w AS prev_role, lag(created_at) OVER w AS prev_at, lead(id) OVER w AS next_id, lead(role) OVER w AS next_role FROM {M} WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY display_order NULLS FIRST, created_at NULLS FIRST, id))"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = "[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0085}}\\x0b]".replace("{{", "{").replace("}}", "}")


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _snippet(c: str, q: str) -> str:
    c = f"replace({c}, chr(10), ' ')"
    at = f"(instr({_LOWER.format(c)}, '{q}') - 1)"
    start, end = f"greatest(0, {at} - 40)", f"least(length({c}), {at} + {len(q) + 60})"
    return f"CASE WHEN length({c}) <= 120 THEN {c} WHEN {at} < 0 THEN substr({c}, 1, 120) || '…' ELSE (CASE WHEN {start} > 0 THEN '…' ELSE '' END) || substr({c}, {start} + 1, {end} - {start}) || (CASE WHEN {end} < length({c}) THEN '…' ELSE '' END) END"


_LINES = "(SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS idx, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_ESTIMATE = "CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE greatest(1, strlen({0}) // 4) END"


def _escape(c: str, html: bool) -> str:
    out = f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), '''', '&#39;')" if html else out


def _greedy(separator: int) -> str:
    return f"""
WITH RECURSIVE lines AS (SELECT doc_id, idx, length(line) AS n FROM {_LINES}),
fold AS (
  SELECT doc_id, idx, n, 0 AS batch, n AS used FROM lines WHERE idx = 0
  UNION ALL
  SELECT l.doc_id, l.idx, l.n,
    CASE WHEN l.n = 0 OR f.used + l.n + {separator} <= 2500 THEN f.batch ELSE f.batch + 1 END,
    CASE WHEN l.n = 0 THEN f.used WHEN f.used + l.n + {separator} <= 2500 THEN f.used + l.n + {separator} ELSE l.n END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.idx = f.idx + 1)"""


_T = _trim("line")
_STATED = f"(SELECT * REPLACE (CASE WHEN file_size % 5 = 0 THEN 'error' WHEN file_size % 5 = 1 THEN 'cancelled' ELSE status END AS status, CASE WHEN file_size % 5 = 0 THEN 'failed' ELSE error_msg END AS error_msg) FROM {FL})"
_MARKED = f"(SELECT doc_id, idx, CASE WHEN idx % 4 = 1 THEN '• ' || line WHEN idx % 4 = 2 THEN '| ' || line || ' | |' ELSE line END AS line FROM {_LINES})"
_UP = f"(length(regexp_replace({_T}, '[^\\p{{L}}]', '', 'g')) >= 10 AND length(regexp_replace({_T}, '[^\\p{{Lu}}]', '', 'g')) >= 0.82 * length(regexp_replace({_T}, '[^\\p{{L}}]', '', 'g')))"
_CELLS = f"(SELECT doc_id, idx, CAST(unnest(range(len(c))) AS INTEGER) AS col, {_trim('unnest(c)')} AS cell FROM (SELECT doc_id, idx, string_split(regexp_replace({_T}, '^\\|+|\\|+$', '', 'g'), '|') AS c FROM {_MARKED} WHERE contains(line, '|')))"

ORACLE = {
    "search_messages": f"""
SELECT m.id AS message_id, m.session_id, s.title AS session_title, m.role, {_snippet("CASE WHEN coalesce(m.translated_content, '') <> '' THEN m.translated_content ELSE coalesce(m.original_content, '') END", 'lease')} AS snippet, m.created_at
FROM {M} m JOIN {S} s ON s.id = m.session_id
WHERE s.status NOT IN ('deleted', 'archived') AND (instr({_LOWER.format('m.original_content')}, 'lease') > 0 OR instr({_LOWER.format('m.translated_content')}, 'lease') > 0)
ORDER BY m.created_at DESC, m.id LIMIT 50""",
    "sessions_sorted": f"SELECT id, title, status, updated_at, CAST(row_number() OVER (ORDER BY CASE WHEN status = 'pinned' THEN 0 ELSE 1 END, updated_at DESC NULLS LAST, id) AS INTEGER) AS place FROM {S} WHERE status NOT IN ('deleted', 'archived') QUALIFY place <= 100",
    "search_blank": "SELECT 0 AS hits",
    "messages_page_first": f"SELECT id, display_order, role FROM {HOT} ORDER BY display_order DESC NULLS LAST, id LIMIT 20",
    "messages_page_cursor": f"SELECT id, display_order, role FROM {HOT} WHERE display_order < 500 ORDER BY display_order DESC, id LIMIT 60",
    "messages_page_has_more": f"""
WITH top AS (SELECT display_order AS o FROM {HOT} ORDER BY display_order DESC NULLS LAST, id LIMIT 20)
SELECT CAST(count(*) AS INTEGER) AS n, CASE WHEN count(*) = 20 AND EXISTS (SELECT 1 FROM {HOT} WHERE display_order < (SELECT min(o) FROM top)) THEN min(o) ELSE 0 END AS next_cursor,
  count(*) = 20 AND EXISTS (SELECT 1 FROM {HOT} WHERE display_order < (SELECT min(o) FROM top)) AS has_more FROM top""",
    "message_with_file_size": f"SELECT m.id, m.file_id, coalesce(f.file_size, 0) AS file_size FROM {M} m LEFT JOIN {FL} f ON f.id = m.file_id",
    "cancelled_files": f"SELECT id, session_id FROM {_STATED} WHERE status = 'cancelled'",
    "next_display_order": f"SELECT session_id, coalesce(max(display_order), 0) + 1 AS next_order FROM {M} WHERE session_id IS NOT NULL GROUP BY 1",
    "prev_next_message": f"SELECT id, CASE WHEN lower(trim(prev_role)) = 'user' THEN prev_id END AS prev_user_id, CASE WHEN lower(trim(next_role)) = 'assistant' THEN next_id END AS next_assistant_id FROM {ORDERED}",
    "date_separators": f"SELECT id, CAST(created_at AS DATE) IS DISTINCT FROM CAST(prev_at AS DATE) AS separator FROM {ORDERED}",
    "quoted_message_join": f"""
SELECT m.id, m.original_message_id, CASE WHEN length(q.t) > 140 THEN substr(q.t, 1, 140) || '…' ELSE q.t END AS quote, q.id IS NOT NULL AS found
FROM {M} m LEFT JOIN (SELECT id, {_trim(f"regexp_replace(original_content, '{_WS}+', ' ', 'g')")} AS t FROM {M}) q ON q.id = m.original_message_id WHERE m.original_message_id <> ''""",
    "search_hit_remap": f"SELECT id, CASE WHEN lower(trim(role)) = 'user' AND lower(trim(next_role)) = 'assistant' THEN next_id ELSE id END AS shown_id FROM {ORDERED} WHERE instr({_LOWER.format('original_content')}, 'lease') > 0",
    "sessions_by_day": f"SELECT CAST(updated_at AS DATE) AS day, count(*) AS sessions, max(updated_at) AS newest, min(id) AS first_id FROM {S} WHERE status NOT IN ('deleted', 'archived') GROUP BY 1",
    "pinned_partition": f"SELECT coalesce(status = 'pinned', false) AS pinned, count(*) AS sessions FROM {S} GROUP BY 1",
    "page_union_dedup": f"SELECT id, display_order, CASE WHEN n <= 60 THEN 1 ELSE 2 END AS page FROM (SELECT *, row_number() OVER (ORDER BY display_order DESC NULLS LAST, id) AS n FROM {HOT}) WHERE n <= 100",
    "page_upsert_last_wins": f"SELECT id, display_order, CASE WHEN n <= 10 THEN -1 ELSE tokens END AS tokens FROM (SELECT *, row_number() OVER (ORDER BY display_order DESC NULLS LAST, id) AS n FROM {HOT}) WHERE n <= 60",
    "settings_upsert": "SELECT * FROM (VALUES ('model', 'standard'), ('target_lang', 'vi'), ('style', 'casual'), ('theme', 'dark')) t(key, value)",
    "settings_map_defaults": "SELECT 'standard' AS model, 'business' AS style, 'light' AS theme",
    "insert_or_ignore": "SELECT id FROM doc_types UNION SELECT doc_type FROM glossary_entries WHERE doc_type IS NOT NULL",
    "update_by_key": f"SELECT id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'error' THEN NULL ELSE error_msg END AS error_msg FROM {_STATED}",
    "clear_tag_update": "SELECT id, CASE WHEN current_file_name LIKE '%.docx' THEN NULL ELSE current_file_name END AS current_file_name FROM glossary_entries",
    "delete_rows": f"SELECT id FROM {_STATED} WHERE status IS NULL OR status NOT IN ('cancelled', 'error')",
    "delete_cascade": f"SELECT id, session_id FROM {M} WHERE session_id IS NULL OR session_id IN (SELECT id FROM {S} WHERE status <> 'deleted')",
    "delete_set_null": f"SELECT m.id, f.id AS file_id FROM {M} m LEFT JOIN {_STATED} f ON f.id = m.file_id AND f.status IS DISTINCT FROM 'cancelled'",
    "check_violations": f"""
SELECT id, 'role' AS rule FROM {M} WHERE NOT coalesce(role IN ('user', 'assistant'), false)
UNION ALL SELECT id, 'mode' FROM {M} WHERE NOT coalesce(display_mode IN ('bubble', 'bilingual', 'file'), false)
UNION ALL SELECT id, 'session' FROM {M} WHERE session_id IS NULL""",
    "unique_violations": f"SELECT session_id, display_order, count(*) AS n FROM {M} GROUP BY 1, 2 HAVING count(*) > 1",
    "migration_recode": f"SELECT id, CASE WHEN file_id IS NOT NULL AND display_mode = 'bilingual' THEN 'file' ELSE display_mode END AS display_mode FROM {M}",
    "glossary_for_file": """
WITH l AS (SELECT e.current_file_name, e.id, string_agg(v.source, ' / ' ORDER BY v.source) || ' → ' || e.target AS line
  FROM glossary_entries e JOIN glossary_variants v ON v.entry_id = e.id WHERE e.current_file_name IS NOT NULL GROUP BY e.current_file_name, e.id, e.target)
SELECT current_file_name, string_agg(line, chr(10) ORDER BY id) AS glossary FROM l GROUP BY 1""",
    "glossary_match_or_insert": """
WITH asked AS (SELECT e.id AS term_id, e.source_lang, e.target_lang, e.doc_type, list(v.source ORDER BY v.source) AS sources FROM glossary_entries e JOIN glossary_variants v ON v.entry_id = e.id GROUP BY ALL),
x AS (SELECT term_id, source_lang, target_lang, doc_type, unnest(sources) AS s, unnest(range(len(sources))) AS n FROM asked),
hit AS (SELECT x.term_id, min({'n': x.n, 'e': e.id}) AS b FROM x JOIN glossary_variants v ON v.source = x.s JOIN glossary_entries e ON e.id = v.entry_id AND e.source_lang = x.source_lang AND e.target_lang = x.target_lang AND e.doc_type = x.doc_type GROUP BY 1)
SELECT a.term_id, h.b.e AS entry_id, h.term_id IS NULL AS is_new FROM asked a LEFT JOIN hit h USING (term_id)""",
    "active_rules": "SELECT 'legal' AS doc_type, 'ja' AS target_lang, 'Use polite forms.' || chr(10) || chr(10) || 'Be formal.' || chr(10) || chr(10) || 'Use legal terms.' AS rules",
    "active_rules_join": """
WITH r(id, content, d, t, o) AS (VALUES ('r1', 'Be formal.', NULL, NULL, 1), ('r2', 'Use legal terms.', 'legal', NULL, 2), ('r3', 'Use polite forms.', NULL, 'ja', 0))
SELECT w.doc_type, w.target_lang, string_agg(r.content, chr(10) || chr(10) ORDER BY r.o) AS rules
FROM (SELECT DISTINCT doc_type, target_lang FROM glossary_entries) w JOIN r ON (r.d IS NULL OR r.d = w.doc_type) AND (r.t IS NULL OR r.t = w.target_lang) GROUP BY 1, 2""",
    "doc_type_title_case": "SELECT id, list_aggregate(list_transform(string_split(id, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') AS title FROM doc_types",
    "token_estimate": f"SELECT doc_id, CAST({_ESTIMATE.format('text')} AS INTEGER) AS tokens FROM documents",
    "file_info_estimates": "SELECT file_id, CAST(c AS INTEGER) AS chunks, CAST(greatest(1, (c + 1) // 2) AS INTEGER) AS minutes FROM (SELECT file_id, greatest(1, (coalesce(char_count, 0) + 2499) // 2500) AS c FROM file_infos)",
    "char_page_counts": "SELECT doc_id, coalesce(length(text), 0) AS chars, CAST(greatest(1, (coalesce(length(text), 0) + 2799) // 2800) AS INTEGER) AS pages FROM documents",
    "language_hint_backend": f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[{VIETNAMESE_ONLY}]') THEN 'vi' WHEN regexp_matches(text, '[\\p{{Han}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN 'auto'
  WHEN length({_trim('text')}) >= 28 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 14 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.88 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) THEN 'en' ELSE 'auto' END AS hint FROM documents""",
    "language_hint_frontend": f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[{VIETNAMESE_WIDE}]') THEN 'vi' ELSE 'unknown' END AS guess FROM documents",
    "letter_ratios": "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS ascii FROM documents",
    "heading_level": f"""
SELECT * FROM (SELECT doc_id, idx, CAST(CASE WHEN length({_T}) < 4 THEN 0 WHEN regexp_matches({_T}, '^\\d+\\.\\d+\\.\\d+\\.?\\s+\\S') THEN 4 WHEN regexp_matches({_T}, '^\\d+\\.\\d+\\.?\\s+\\S') THEN 3
  WHEN regexp_matches({_T}, '^\\d+\\.\\s+\\S') OR regexp_matches({_T}, '^({ROMAN})\\.\\s+\\S') OR regexp_matches({_T}, '(?i)^({SECTION_WORDS})\\s+') THEN 2
  WHEN {_UP} AND length({_T}) BETWEEN 12 AND 360 THEN 2 ELSE 0 END AS INTEGER) AS level FROM {_LINES}) WHERE level > 0""",
    "bullet_normalize": f"SELECT doc_id, idx, '- ' || {_trim("regexp_replace(line, '^[•+]\\s+', '')")} AS line FROM {_MARKED} WHERE regexp_matches(line, '^[•+]\\s+')",
    "markdown_likeness": "SELECT doc_id, coalesce(contains(text, '##') OR regexp_matches(text, '(?m)^\\s*##? ') OR len(string_split(text, '**')) > 2 OR (contains(text, '![') AND contains(text, '](')), false) AS markdown FROM documents",
    "strip_tags": "SELECT doc_id, md5(regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g')) AS plain FROM documents",
    "escape_html": f"SELECT doc_id, md5({_escape('text', True)}) AS html FROM documents",
    "escape_xml": f"SELECT doc_id, md5({_escape('text', False)}) AS xml, text = replace(replace(replace(replace(replace({_escape('text', False)}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') AS same FROM documents",
    "truncate_runes": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS short FROM documents",
    "session_title": f"""
WITH t AS (SELECT id, CASE WHEN length(title) % 3 <> 0 THEN {_trim('title')} END AS t, {_trim("regexp_replace(split_part('## About ' || title, chr(10), 1), '^#+', '')")} AS c FROM {S})
SELECT id, CASE WHEN coalesce(t, '') <> '' THEN CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END WHEN c IS NULL THEN 'Phiên dịch' WHEN length(c) > 50 THEN substr(c, 1, 50) || '…' ELSE c END AS title FROM t""",
    "content_title": f"""
WITH a AS (SELECT doc_id, coalesce({_trim('text')}, '') AS t FROM documents), b AS (SELECT doc_id, t, {_trim("split_part(t, chr(10), 1)")} AS f FROM a),
c AS (SELECT doc_id, t, CASE WHEN starts_with(f, '#') THEN {_trim("regexp_replace(f, '^#+', '')")} ELSE f END AS f FROM b)
SELECT doc_id, CASE WHEN t = '' THEN 'Phiên dịch' WHEN length(f) > 50 THEN substr(f, 1, 50) || '…' ELSE f END AS title FROM c""",
    "quote_snippet": f"SELECT id, CASE WHEN length(t) > 140 THEN substr(t, 1, 140) || '…' ELSE t END AS quote FROM (SELECT id, {_trim(f"regexp_replace(original_content, '{_WS}+', ' ', 'g')")} AS t FROM {M})",
    "search_snippet": f"SELECT doc_id, {_snippet('text', 'lease')} AS snippet FROM documents",
    "keyword_highlight": "SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)lease')) AS INTEGER) AS n FROM documents) WHERE n > 0",
    "file_size_label": f"SELECT id, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN format('{{:.1f}} KB', file_size / 1024) ELSE format('{{:.1f}} MB', file_size / 1048576) END AS label FROM {FL}",
    "file_titles": f"SELECT id, regexp_replace(file_name, '\\.[^.]+$', '') AS title FROM {FL}",
    "attachment_names": f"SELECT id, regexp_extract(original_content, '^📎\\s*(.+?)\\s*$', 1) AS name FROM {M} WHERE starts_with(original_content, '📎')",
    "date_label": f"""
SELECT id, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n BETWEEN 2 AND 3 THEN n || ' days ago' ELSE dayname(d) END AS label
FROM (SELECT id, CAST(updated_at AS DATE) AS d, date_diff('day', CAST(updated_at AS DATE), DATE '2026-06-30') AS n FROM {S} WHERE updated_at IS NOT NULL)""",
    "refusal_filter": f"SELECT id FROM {M} WHERE regexp_matches(lower({_trim('translated_content')}), '^(i''m sorry, but i cannot|i''m sorry, i cannot|i''m unable to|i cannot assist|i can''t help with that|sorry, but i cannot|i cannot provide|i''m not able to|as an ai)')",
    "json_salvage": """
SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 5 = 0 OR length(coalesce(text, '')) % 3 = 0 THEN '' ELSE coalesce(doc_type, '') END AS kind,
  CASE WHEN length(coalesce(text, '')) % 5 = 0 OR length(coalesce(text, '')) % 3 = 0 THEN '' ELSE 's' || doc_id END AS summary FROM documents""",
    "paragraph_batches": _greedy(1) + " SELECT doc_id, idx, n, CAST(batch AS INTEGER) AS batch FROM fold",
    "xlsx_batches": _greedy(0) + " SELECT doc_id, idx, n, CAST(batch AS INTEGER) AS batch FROM fold",
    "batch_offsets": _greedy(1) + " SELECT doc_id, CAST(batch AS INTEGER) AS batch, min(idx) AS first, count(*) AS items FROM fold GROUP BY doc_id, batch",
    "segment_batches": f"""
WITH RECURSIVE l AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx, length(line) AS n, starts_with(line, '#') AS h FROM {_LINES} WHERE {_T} <> ''),
fold AS (
  SELECT doc_id, idx, h, 0 AS batch, n AS used, 1 AS c FROM l WHERE idx = 0
  UNION ALL
  SELECT l.doc_id, l.idx, l.h, CASE WHEN f.h OR l.h OR f.used + l.n > 5000 OR f.c >= 30 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.h OR l.h OR f.used + l.n > 5000 OR f.c >= 30 THEN l.n ELSE f.used + l.n END, CASE WHEN f.h OR l.h OR f.used + l.n > 5000 OR f.c >= 30 THEN 1 ELSE f.c + 1 END
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.idx = f.idx + 1)
SELECT doc_id, idx, CAST(batch AS INTEGER) AS batch FROM fold""",
    "marker_encode": f"""
WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM {_LINES} WHERE {_T} <> '')
SELECT d.doc_id, md5(coalesce(x.e, '')) AS encoded FROM documents d LEFT JOIN (SELECT doc_id, string_agg('<<<' || k || '>>>' || chr(10) || line, chr(10) || chr(10) ORDER BY k) AS e FROM l GROUP BY 1) x USING (doc_id) WHERE d.text IS NOT NULL""",
    "marker_decode": f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n, true AS same FROM {_LINES} WHERE {_T} <> '' AND NOT starts_with({_T}, '<') GROUP BY 1",
    "translation_fallback": f"""
SELECT id, md5(CASE WHEN coalesce({_trim('translated_content')}, '') = '' OR regexp_matches(lower({_trim('translated_content')}), '^(i''m sorry, but i cannot|i''m sorry, i cannot|i''m unable to|i cannot assist|i can''t help with that|sorry, but i cannot|i cannot provide|i''m not able to|as an ai)')
  THEN original_content ELSE translated_content END) AS shown FROM {M} WHERE lower(trim(role)) = 'assistant'""",
    "token_rollup": f"SELECT session_id, CAST(CASE WHEN coalesce(sum(tokens), 0) > 0 THEN sum(tokens) ELSE sum({_ESTIMATE.format('translated_content')}) END AS BIGINT) AS tokens FROM {M} WHERE session_id IS NOT NULL GROUP BY 1",
    "stream_fold_batch": """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'chunk' WHEN event_type = 'purchase' THEN 'usage' WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS type, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS tokens FROM events),
g AS (SELECT user_id, coalesce(string_agg(event_id || ';', '' ORDER BY event_id) FILTER (type = 'chunk'), '') AS body, coalesce(sum(tokens), 0) AS used, coalesce(arg_max(type, event_id) FILTER (type IN ('done', 'error')), 'streaming') AS status FROM e GROUP BY 1),
t AS (SELECT *, CASE WHEN status = 'error' THEN '' ELSE body END AS text FROM g)
SELECT CAST(user_id AS VARCHAR) AS stream_id, status, md5(text) AS text, CAST(CASE WHEN used > 0 THEN used WHEN text = '' THEN 0 ELSE greatest(1, strlen(text) // 4) END AS INTEGER) AS tokens FROM t""",
    "progress_percent": f"SELECT id, CAST(display_order * 100 // 250 AS INTEGER) AS percent FROM {M} WHERE display_order >= 0",
    "progress_thinning": f"""
WITH RECURSIVE n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
fold AS (
  SELECT doc_id, n, 1 AS i, 100 // n AS last, CAST(100 // n AS VARCHAR) AS emitted FROM n
  UNION ALL
  SELECT doc_id, n, i + 1, CASE WHEN (i + 1) * 100 // n >= last + 5 THEN (i + 1) * 100 // n ELSE last END, CASE WHEN (i + 1) * 100 // n >= last + 5 THEN emitted || ',' || ((i + 1) * 100 // n) ELSE emitted END FROM fold WHERE i < n)
SELECT doc_id, emitted FROM fold WHERE i = n""",
    "blocks_from_markdown": f"""
WITH l AS (SELECT doc_id, idx, line, {_T} = '' AS blank, starts_with({_T}, '#') AS head FROM {_LINES}),
m AS (SELECT *, sum(CASE WHEN blank OR head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM l),
g AS (SELECT doc_id, b, string_agg(line, chr(10) ORDER BY idx) AS block FROM m WHERE NOT blank GROUP BY 1, 2)
SELECT d.doc_id, CAST(count(g.block) AS INTEGER) AS blocks, md5(coalesce(string_agg(g.block, chr(1) ORDER BY g.b), '')) AS digest FROM documents d LEFT JOIN g USING (doc_id) WHERE d.text IS NOT NULL GROUP BY 1""",
    "block_filters": f"""
SELECT * FROM (SELECT doc_id, idx, regexp_matches({_T}, '^[A-Z]$') OR regexp_matches({_T}, '^[^\\x00-\\x7f\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]{{1,4}}$') AS noise,
  length({_T}) BETWEEN 1 AND 60 AND length(regexp_replace({_T}, '[^a-z]', '', 'g')) <= 3 AND (contains(upper({_T}), 'TM/') OR contains(upper({_T}), 'UBHC')) AS stamp,
  starts_with({_T}, '**') AND ends_with({_T}, '**') AND strlen({_T}) >= 5 AND NOT contains(substr({_T}, 3, greatest(0, length({_T}) - 4)), '**') AS bold,
  NOT regexp_matches(line, '^[#|*!>-]') AND length({_T}) BETWEEN 4 AND 100 AND NOT regexp_matches({_T}, '\\p{{Ll}}') AS implied FROM {_LINES}) WHERE noise OR stamp OR bold OR implied""",
    "table_cells": f"SELECT doc_id, idx, col, cell FROM {_CELLS}",
    "table_drop_empty_columns": f"WITH c AS (SELECT * FROM {_CELLS}) SELECT doc_id, idx, col, cell FROM c WHERE (doc_id, col) IN (SELECT doc_id, col FROM c WHERE cell <> '')",
    "docx_paragraphs": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx, md5(line) AS digest FROM {_LINES} WHERE {_T} <> ''",
    "xlsx_strings": f"SELECT doc_id, idx, md5(line) AS digest, regexp_matches(line, '\\p{{L}}') AS translatable FROM {_LINES}",
    "sentence_split": """
WITH p AS (SELECT doc_id, list_filter(flatten(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])(\\s)', E'\\\\1\\x01\\\\2', 'g'), '([。！？])', E'\\\\1\\x01', 'g'), chr(1)), lambda h: string_split(h, chr(10)))), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, length(unnest(s)) AS n FROM p""",
    "external_map_stub": f"SELECT id, md5('[' || coalesce(target_lang, '') || '] ' || original_content) AS digest FROM {M} WHERE original_content <> ''",
}
