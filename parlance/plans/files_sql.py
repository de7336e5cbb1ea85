"""DuckDB SQL with the results of the queries of files, pages, translations, display and streams."""

from __future__ import annotations

from parlance.functions.display import DEFAULT_MODEL, TARGET_LABELS
from parlance.functions.text import ROMAN, SECTION_WORDS
from parlance.plans.workspace_sql import _LINES, _T, _UP, _WS, FL, HOT, M, ORACLE as FIRST, ORDERED, S, _escape, _trim

_NL = "chr(10)"
_D = "documents WHERE text IS NOT NULL"
_SIDES = f"(SELECT id, string_split(original_content, {_NL}) AS src, string_split(translated_content, {_NL}) AS tgt FROM {M} WHERE original_content <> '' AND translated_content <> '')"
_TABLES = """(SELECT source, doc_id AS page, '<table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>[' || doc_id || ']</td><td>a</td></tr>' ||
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<tr><th colspan="2">b</th></tr><tr><td>c</td><td>d</td></tr>' END || '</tbody></table>' AS html FROM documents WHERE source IS NOT NULL)"""
_EVENTS = "(SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'chunk' WHEN event_type = 'purchase' THEN 'usage' WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS type, strlen(event_id || ';') AS bytes FROM events)"
_ERRORS = "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 150 + 400 END AS status, CASE WHEN event_id % 3 = 0 THEN 'Connection refused' WHEN event_id % 5 = 0 THEN 'read: unexpected EOF' ELSE 'bad request' END AS said FROM events)"


def _level(c: str) -> str:
    up = f"(length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) >= 10 AND length(regexp_replace({c}, '[^\\p{{Lu}}]', '', 'g')) >= 0.82 * length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')))"
    return f"""CASE WHEN length({c}) < 4 THEN 0 WHEN regexp_matches({c}, '^\\d+\\.\\d+\\.\\d+\\.?\\s+\\S') THEN 4 WHEN regexp_matches({c}, '^\\d+\\.\\d+\\.?\\s+\\S') THEN 3
  WHEN regexp_matches({c}, '^\\d+\\.\\s+\\S') OR regexp_matches({c}, '^({ROMAN})\\.\\s+\\S') OR regexp_matches({c}, '(?i)^({SECTION_WORDS})\\s+') THEN 2
  WHEN {up} AND length({c}) BETWEEN 12 AND 360 THEN 2 ELSE 0 END"""


def _paragraphs(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({_trim(c)}, '\\n{{3,}}', {_NL} || {_NL}, 'g'), {_NL} || {_NL}), lambda p: {_trim('p')}), lambda p: p <> '')"


def _collapsed(c: str) -> str:
    line = _trim(f"regexp_replace(x, '{_WS}+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(string_split({c}, {_NL} || {_NL}), lambda p: array_to_string(list_transform(string_split({_trim('p')}, {_NL}), lambda x: {line}), {_NL})), lambda p: p <> ''), {_NL} || {_NL})"


def _fields(c: str) -> str:
    c = f"regexp_replace({c}, '(?i)INCLUDEPICTURE\\s+\"([^\"]+)\"', {_NL} || {_NL} || '![](\\1)' || {_NL} || {_NL}, 'g')"
    c = f"regexp_replace({c}, '(?i)HYPERLINK\\s+\"([^\"]+)\"', {_NL} || '[\\1](\\1)' || {_NL}, 'g')"
    return f"regexp_replace({c}, '(?i)\\s*\\*?\\s*MERGEFORMAT\\w*', '', 'g')"


def _unescaped(c: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#34;", '"'), ("&apos;", "''")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"replace(replace({c}, '&nbsp;', chr(160)), '&amp;', '&')"


_XML = f"'<w:p><w:r><w:t>' || {_escape('text', False)} || '</w:t></w:r></w:p><w:p><w:del w:id=\"1\"><w:t>gone</w:t></w:del><w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/>c</w:p><w:p>INCLUDEPICTURE \"http://x/y.png\" \\* MERGEFORMATINET and hyperlink \"http://z\" end &amp;amp; &quot;q&quot;</w:p>'"
_PLAIN = f"replace(replace(replace(regexp_replace({_XML}, '(?s)<w:del\\b[^>]*>.*?</w:del>', '', 'g'), '</w:p>', {_NL} || {_NL}), '<w:br/>', {_NL}), '<w:tab/>', chr(9))"
def _blocks(side: str, column: str) -> str:
    kept = f"list_filter({column}, lambda x: {_trim('x')} <> '')"
    return f"SELECT id, '{side}' AS side, CAST(unnest(range(len(b))) AS INTEGER) AS block, unnest(b) AS b FROM (SELECT id, {kept} AS b FROM sides)"


_MARKED = "string_split(regexp_replace(regexp_replace(b, '([.!?])(\\s)', E'\\\\1\\x01\\\\2', 'g'), '([。！？])', E'\\\\1\\x01', 'g'), chr(1))"
_BODY = f"""
all_ AS ({_blocks('s', 'src')} UNION ALL {_blocks('t', 'tgt')}),
cut AS (SELECT id, side, block, list_filter({_MARKED}, lambda x: {_trim('x')} <> '') AS s FROM all_),
sent AS (SELECT id, side, block, CAST(unnest(range(len(s))) AS INTEGER) AS sentence, length({_trim('unnest(s)')}) AS n FROM cut)"""

_LIVE = "lower(status) NOT IN ('deleted', 'archived')"

def _docx(translated: bool) -> str:
    text = "CASE WHEN idx % 2 = 0 THEN '<' || t || '>' ELSE t END" if translated else "t"
    return f"""
WITH d AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx, line AS t FROM {_LINES} WHERE {_T} <> ''),
n AS (SELECT doc_id, CAST(count(d.idx) AS INTEGER) AS n FROM documents LEFT JOIN d USING (doc_id) WHERE text IS NOT NULL GROUP BY 1),
a AS (SELECT doc_id, 'word/document.xml' AS part, idx, t FROM d UNION ALL SELECT doc_id, 'word/document.xml', n, 'Boxed' FROM n
  UNION ALL SELECT doc_id, 'word/header1.xml', 0, 'Head & ' || {_trim('substr(text, 1, 5)')} || '.' FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS path, part, idx, md5({text}) AS digest FROM a"""


ORACLE = {
    "docx_parts": _docx(False),
    "docx_translated": _docx(True),
    "xlsx_translated": f"""
SELECT CAST(doc_id AS VARCHAR) AS path, idx, md5(CASE WHEN regexp_matches(line, '\\p{{L}}') THEN '<' || line || '>' ELSE line END) AS digest FROM {_LINES}
UNION ALL SELECT CAST(doc_id AS VARCHAR), -1, md5('Tab "1" & more!') FROM documents WHERE text IS NOT NULL""",
    "file_by_id": f"SELECT id, file_name, status FROM {FL} WHERE id = (SELECT min(id) FROM files)",
    "session_lookup": f"SELECT id, title, status FROM {S} WHERE id = (SELECT min(id) FROM sessions) AND status IN ('active', 'pinned')",
    "pdf_scan_info": """
WITH p AS (SELECT session_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY session_id ORDER BY doc_id) AS nth FROM documents WHERE session_id IS NOT NULL),
g AS (SELECT session_id, count(*) AS pages, coalesce(sum(n) FILTER (nth <= 10), 0) AS s FROM p GROUP BY 1), m AS (SELECT *, s // least(pages, 10) AS mean FROM g)
SELECT session_id, pages, mean < 50 AS is_scanned, CAST(CASE WHEN mean < 50 THEN pages * 2000 WHEN pages > 10 THEN mean * pages ELSE s END AS BIGINT) AS char_count FROM m""",
    "page_texts": f"SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS page, md5(unnest(p)) AS digest FROM (SELECT doc_id, string_split(replace(replace(text, {_NL} || {_NL}, chr(12)), chr(13) || {_NL}, {_NL}), chr(12)) AS p FROM {_D})",
    "converter_cleanup": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '</?[a-zA-Z][^>]*>', '', 'g') || {_NL} || {_NL} || 'x', '\\n{{3,}}', {_NL} || {_NL}, 'g')) AS digest FROM documents",
    "ocr_pages": f"SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) + 1 AS page_no, md5(unnest(p)) AS digest FROM (SELECT doc_id, string_split(text, {_NL} || {_NL}) AS p FROM {_D})",
    "ocr_first_pages": f"SELECT doc_id, md5(array_to_string(p, {_NL} || {_NL})) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, {_NL} || {_NL})[1:3], lambda x: {_trim('x')}), lambda x: x <> '') AS p FROM {_D}) WHERE len(p) > 0",
    "file_dispatch": f"""
WITH f AS (SELECT id, lower(regexp_extract(coalesce(file_name, ''), '\\.([^.]+)$', 1)) AS kind, file_size, page_count, char_count FROM {FL}),
g AS (SELECT *, CASE WHEN kind NOT IN ('pdf', 'docx', 'xlsx') THEN 'unsupported' WHEN kind = 'pdf' AND file_size > 52428800 THEN 'too large' WHEN kind = 'pdf' AND coalesce(page_count, 0) < 1 THEN 'no pages'
  WHEN kind = 'pdf' AND page_count > 200 THEN 'too many pages' WHEN kind = 'xlsx' AND coalesce(char_count, 0) < 1 THEN 'no text' END AS problem, greatest(1, (coalesce(char_count, 0) + 2499) // 2500) AS c FROM f)
SELECT id, kind, problem, CAST(CASE WHEN problem IS NULL THEN c END AS INTEGER) AS chunks, CAST(CASE WHEN problem IS NULL THEN greatest(1, (c + 1) // 2) END AS INTEGER) AS minutes FROM g""",
    "insert_rows": "SELECT id, source_lang, target_lang, target FROM glossary_entries UNION ALL SELECT 'copy-' || id, target_lang, source_lang, target FROM glossary_entries WHERE source_lang = 'en'",
    "insert_numbered_messages": f"SELECT session_id, doc_id, row_number() OVER (PARTITION BY session_id ORDER BY doc_id) + coalesce((SELECT max(display_order) FROM {M} m WHERE m.session_id = d.session_id), 0) AS display_order FROM documents d WHERE session_id IS NOT NULL",
    "insert_select_filtered": f"SELECT id, file_type, file_size FROM {FL} WHERE file_type IN ('docx')",
    "publish_tables": "SELECT 'entries' AS name, id AS key, target AS text FROM glossary_entries UNION ALL SELECT 'variants', entry_id, source FROM glossary_variants",
    "log_lines": f"""
WITH v AS (SELECT id, updated_at, coalesce(file_name, '') AS n, coalesce(status, '') AS s FROM {FL} WHERE updated_at IS NOT NULL)
SELECT id, '[' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') || '] [INFO ] FileStatus | name=' || CASE WHEN contains(n, ' ') OR contains(n, '"') THEN '"' || replace(replace(n, '\\', '\\\\'), '"', '\\"') || '"' ELSE n END || ' status=' || s AS line, 'INFO' AS level, 'FileStatus' AS event FROM v""",
    "validation_flags": f"SELECT id, coalesce({_trim('original_content')}, '') = '' AS no_content, coalesce({_trim('target_lang')}, '') = '' AS no_target, coalesce({_trim('session_id')}, '') = '' AS no_session FROM {M}",
    "region_translations": f"""
WITH s AS (SELECT id, CAST(unnest(range(len(src))) AS INTEGER) AS idx, unnest(src) AS s FROM {_SIDES}), t AS (SELECT id, CAST(unnest(range(len(tgt))) AS INTEGER) AS idx, unnest(tgt) AS t FROM {_SIDES})
SELECT id, idx, CAST(length(s) AS INTEGER) AS source_chars, md5(t) AS digest FROM s LEFT JOIN t USING (id, idx)""",
    "translated_html": f"""
SELECT id, md5('<div class="page" id="page-1">' || {_NL} || array_to_string(list_transform(list_filter(list_transform(tgt[1:len(src)], lambda x: {_trim('x')}), lambda x: x <> ''), lambda x: '<p>' || {_escape('x', True)} || '</p>' || {_NL}), '') || '</div>' || {_NL}) AS digest FROM {_SIDES}""",
    "zip_paragraphs": f"""
SELECT id, CAST(i AS INTEGER) AS idx, len(src) = len(tgt) AS same, CAST(length(src[i + 1]) AS INTEGER) AS source_chars, CAST(length(tgt[i + 1]) AS INTEGER) AS target_chars FROM (SELECT id, src, tgt, unnest(range(greatest(len(src), len(tgt)))) AS i FROM {_SIDES})""",
    "bilingual_pairs": f"""
WITH sides AS (SELECT * FROM {_SIDES}), {_BODY}
SELECT coalesce(a.id, b.id) AS id, coalesce(a.block, b.block) AS block, coalesce(a.sentence, b.sentence) AS sentence, CAST(a.n AS INTEGER) AS source_chars, CAST(b.n AS INTEGER) AS target_chars
FROM (SELECT * FROM sent WHERE side = 's') a FULL JOIN (SELECT * FROM sent WHERE side = 't') b ON a.id = b.id AND a.block = b.block AND a.sentence = b.sentence""",
    "translatable_chars": f"SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS chars FROM documents d LEFT JOIN (SELECT doc_id, sum(length(line)) AS n FROM {_LINES} WHERE regexp_matches(line, '\\p{{L}}') GROUP BY 1) USING (doc_id)",
    "region_counts": "SELECT d.source, CAST(sum(b.blocks) AS BIGINT) AS blocks FROM documents d JOIN (" + FIRST["blocks_from_markdown"] + ") b USING (doc_id) GROUP BY 1",
    "glossary_line_counts": "SELECT current_file_name, CAST(CASE WHEN trim(glossary) = '' THEN 0 ELSE len(string_split(glossary, chr(10))) END AS INTEGER) AS n FROM (" + FIRST["glossary_for_file"] + ")",
    "sessions_of_day": f"SELECT CAST(updated_at AS DATE) AS day, string_agg(id, ',' ORDER BY updated_at DESC NULLS FIRST, id) AS ids FROM {S} WHERE status NOT IN ('deleted', 'archived') GROUP BY 1",
    "page_ascending": f"SELECT string_agg(id, ',' ORDER BY display_order, id) AS ids FROM (SELECT id, display_order FROM {HOT} ORDER BY display_order DESC, id LIMIT 60)",
    "names_in_order": "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS place, name FROM doc_types",
    "prepend_session": f"""
WITH s AS (SELECT id, updated_at FROM {S}), p AS (SELECT * FROM s ORDER BY updated_at DESC NULLS LAST, id LIMIT 20),
n AS (SELECT * FROM (SELECT id FROM s ORDER BY updated_at NULLS FIRST, id LIMIT 1) UNION ALL SELECT * FROM (SELECT id FROM p ORDER BY updated_at NULLS FIRST, id LIMIT 1))
SELECT id, 0 AS place FROM n UNION ALL SELECT id, 1 FROM p WHERE id NOT IN (SELECT id FROM n)""",
    "cross_page_tables": f"""
WITH t AS (SELECT * FROM {_TABLES}), j AS (SELECT t.source, t.page, t.html, n.html AS next FROM t LEFT JOIN t n ON n.source = t.source AND n.page = t.page + 1)
SELECT source, page, md5(CASE WHEN page % 3 = 0 AND next IS NOT NULL THEN replace(html, '</tbody></table>', '<tr><td>k</td><td>v</td></tr>' || regexp_extract(replace(replace(replace(next, ' colspan="2"', ''), '<th>', '<td>'), '</th>', '</td>'), '<tbody>(.*)</tbody>', 1) || '</tbody></table>') ELSE html END) AS digest FROM j""",
    "table_columns": f"SELECT page, 2 AS head, 2 AS body FROM {_TABLES}",
    "docx_whitespace": f"SELECT doc_id, md5({_collapsed('text')}) AS digest FROM documents",
    "docx_plain": f"SELECT doc_id, md5({_trim('c')}) AS digest FROM (SELECT doc_id, {_collapsed('b')} AS c FROM (SELECT doc_id, {_fields('a')} AS b FROM (SELECT doc_id, {_collapsed('u')} AS a FROM (SELECT doc_id, {_unescaped(_trim('v'))} AS u FROM (SELECT doc_id, regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g') AS v FROM {_D})))))",
    "html_unescape": "SELECT doc_id, md5(replace(text, '&nbsp;', '&nbsp;')) AS digest FROM documents",
    "keyword_marks": "SELECT doc_id, md5(regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g')) AS digest FROM documents",
    "footer_time": f"SELECT id, coalesce(strftime(created_at, '%H:%M'), '') AS shown FROM {M}",
    "lang_labels": f"""
WITH m AS (SELECT id, target_lang, {_trim('target_lang')} AS t, lower({_trim("coalesce(source_lang, '')")}) AS s FROM {M})
SELECT id, CASE t {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TARGET_LABELS.items())} ELSE CASE WHEN target_lang = '' THEN 'English (United States)' ELSE target_lang END END AS label,
  CASE WHEN starts_with(s, 'vi') THEN 'vi' WHEN s IN ('auto', '', 'unknown') THEN 'auto' ELSE s END AS source_key FROM m""",
    "style_and_model": f"""
WITH m AS (SELECT id, lower({_trim("coalesce(style, '')")}) AS s, {_trim("coalesce(role, '')")} AS p, {_trim("coalesce(model_used, '')")} AS w FROM {M})
SELECT id, CASE WHEN s IN ('business', 'academic', 'casual') THEN s ELSE 'business' END AS style, CASE WHEN p <> '' AND w <> '' THEN w WHEN p <> '' THEN '{DEFAULT_MODEL}' ELSE 'active' END AS model FROM m""",
    "heading_continuation": f"SELECT doc_id, idx FROM (SELECT doc_id, idx, CASE WHEN idx % 2 = 1 THEN upper(line) WHEN idx % 4 = 2 THEN '(' || line || ')' ELSE line END AS line FROM {_LINES}) WHERE (starts_with({_T}, '(') AND ends_with({_T}, ')') AND length({_T}) <= 80) OR {_UP}",
    "display_flags": f"""
WITH o AS (SELECT id, role, file_id, coalesce(display_mode = 'bilingual', false) OR length(coalesce(original_content, '')) >= 1000 AS own, coalesce(display_mode = 'bilingual', false) OR length(coalesce(translated_content, '')) >= 1000 AS reply,
  coalesce(file_id, '') <> '' AND length(coalesce(original_content, '')) >= 28000 AS heavy, length(coalesce(original_content, '')) >= 12000 AS lazy, next_id, next_role FROM {ORDERED}),
n AS (SELECT a.*, coalesce(lower({_trim('a.next_role')}) = 'assistant' AND b.reply, false) AS answered FROM o a LEFT JOIN o b ON b.id = a.next_id)
SELECT id, own, reply, heavy, lazy, lower({_trim("coalesce(role, '')")}) = 'user' AND coalesce(file_id, '') = '' AND (own OR answered) AS pasted FROM n""",
    "retryable_errors": f"SELECT event_id, coalesce(status IN (429, 500, 502, 503), false) AND said <> 'Connection refused' AS model, CASE WHEN status IS NOT NULL THEN status >= 500 ELSE contains(said, 'EOF') END AS scan FROM {_ERRORS}",
    "retry_delays": """
SELECT CAST(i AS INTEGER) AS attempt, CAST(floor(1000 * pow(2, greatest(i, 0)) * 0.8) AS BIGINT) AS least, CAST(1000 * pow(2, greatest(i, 0)) AS BIGINT) AS even, CAST(floor(1000 * pow(2, greatest(i, 0)) * 1.2) AS BIGINT) AS most, CAST(greatest(i, 0) * 5 AS INTEGER) AS scan FROM range(-1, 5) t(i)""",
    "log_values": """SELECT id, CASE WHEN regexp_matches(source, '[ \\t\\n"]') THEN '"' || replace(replace(replace(replace(source, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"' ELSE source END AS shown FROM glossary_variants WHERE source IS NOT NULL""",
    "paragraphs": f"SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS idx, md5(unnest(p)) AS digest FROM (SELECT doc_id, {_paragraphs('text')} AS p FROM {_D})",
    "inferred_markdown": f"""
WITH d AS (SELECT doc_id, {_trim('text')} AS text FROM documents),
p AS (SELECT doc_id, unnest(range(len(p))) AS pi, unnest(p) AS para FROM (SELECT doc_id, {_paragraphs('text')} AS p FROM d WHERE text IS NOT NULL)),
l AS (SELECT doc_id, pi, row_number() OVER (PARTITION BY doc_id, pi ORDER BY k) AS n, line FROM (SELECT doc_id, pi, unnest(range(len(x))) AS k, {_trim('unnest(x)')} AS line FROM (SELECT doc_id, pi, string_split(para, {_NL}) AS x FROM p)) WHERE line <> ''),
b AS (SELECT *, CASE WHEN regexp_matches(line, '^[•+]\\s+') THEN '- ' || {_trim("regexp_replace(line, '^[•+]\\s+', '')")} ELSE line END AS bl, (starts_with(line, '(') AND ends_with(line, ')') AND length(line) <= 80) OR {_UP.replace(_T, 'line')} AS c FROM l),
f AS (SELECT doc_id, pi, count(*) AS m, max(CASE WHEN n = 1 THEN bl END) AS first, min(CASE WHEN n > 1 AND NOT c THEN n END) AS stop FROM b GROUP BY 1, 2),
g AS (SELECT *, {_level('first')} AS lv FROM f),
h AS (SELECT doc_id, pi, CASE WHEN any_value(lv) > 0 AND (any_value(m) = 1 OR length(any_value(first)) <= 220)
    THEN repeat('#', any_value(lv)) || ' ' || (string_agg(CASE WHEN n = 1 THEN bl ELSE line END, ' ' ORDER BY n) FILTER (n < coalesce(stop, m + 1))) || coalesce({_NL} || {_NL} || (string_agg(line, {_NL} ORDER BY n) FILTER (n >= stop)), '')
    ELSE string_agg(bl, {_NL} ORDER BY n) END AS t FROM g JOIN b USING (doc_id, pi) GROUP BY 1, 2),
r AS (SELECT doc_id, string_agg(t, {_NL} || {_NL} ORDER BY pi) AS t FROM h GROUP BY 1)
SELECT d.doc_id, md5(CASE WHEN contains(text, '##') OR regexp_matches(text, '(?m)^\\s*##? ') OR len(string_split(text, '**')) > 2 OR (contains(text, '![') AND contains(text, '](')) THEN text WHEN text IS NOT NULL THEN coalesce(t, '') END) AS digest FROM d LEFT JOIN r USING (doc_id)""",
    "hard_pieces": f"""
SELECT doc_id, CAST(i AS INTEGER) AS idx, md5(substr(t, i * 500 + 1, 500)) AS digest FROM (SELECT doc_id, t, unnest(range((length(t) + 499) // 500)) AS i FROM (SELECT doc_id, regexp_replace(text, '{_WS}+', '', 'g') AS t FROM {_D}))""",
    "xlsx_preview": f"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, {_NL}), lambda x: {_trim('x')} <> ''), {_NL} || {_NL})) AS digest FROM {_D}",
    "prompt_parts": "WITH g AS (" + FIRST["glossary_for_file"] + f"""),
f AS (SELECT current_file_name, max(doc_type) AS doc_type, max(target_lang) AS target_lang FROM glossary_entries WHERE current_file_name IS NOT NULL GROUP BY 1),
r AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN target_lang = 'ja' THEN 'Use polite forms.' END, 'Be formal.', CASE WHEN doc_type = 'legal' THEN 'Use legal terms.' END) AS rules FROM f)
SELECT current_file_name, md5(concat_ws(chr(10) || chr(10), 'Translate into ' || (CASE {_trim('target_lang')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TARGET_LABELS.items())} ELSE CASE WHEN target_lang = '' THEN 'English (United States)' ELSE target_lang END END) || '.', 'Glossary:' || chr(10) || glossary,
  CASE WHEN doc_type IS NOT NULL AND target_lang IS NOT NULL THEN 'Rules:' || chr(10) || rules END)) AS digest FROM r LEFT JOIN g USING (current_file_name)""",
    "glossary_upsert": """
WITH e AS (SELECT id, target, source_lang, target_lang, doc_type FROM glossary_entries WHERE doc_type IS NOT NULL AND target IS NOT NULL), v AS (SELECT DISTINCT entry_id, source FROM glossary_variants WHERE source IS NOT NULL),
a AS (SELECT e.id, target, source_lang, target_lang, CASE WHEN doc_type = 'legal' THEN 'lease' ELSE doc_type END AS doc_type, list_sort(list(source)) AS s FROM e JOIN v ON v.entry_id = e.id GROUP BY ALL),
x AS (SELECT id, target, source_lang, target_lang, doc_type, unnest(range(2 * len(s))) AS n, unnest(list_concat(s, list_transform(s, lambda y: upper(y)))) AS source FROM a),
hit AS (SELECT x.id, arg_min(k.id, (x.n, k.id)) AS entry_id FROM x JOIN (SELECT e.*, v.source FROM e JOIN v ON v.entry_id = e.id) k ON k.source = x.source AND k.source_lang = x.source_lang AND k.target_lang = x.target_lang AND k.doc_type = x.doc_type GROUP BY 1),
entries AS (SELECT id, target, doc_type FROM e UNION ALL SELECT 'new-' || id, target, doc_type FROM a WHERE id NOT IN (SELECT id FROM hit)),
variants AS (SELECT entry_id, source FROM v UNION SELECT coalesce(h.entry_id, 'new-' || x.id), x.source FROM x LEFT JOIN hit h ON h.id = x.id),
lines AS (SELECT n.id, n.doc_type, string_agg(w.source, ' / ' ORDER BY w.source) || ' → ' || n.target AS line FROM entries n JOIN variants w ON w.entry_id = n.id GROUP BY n.id, n.doc_type, n.target)
SELECT doc_type, md5(string_agg(line, chr(10) ORDER BY id)) AS digest FROM lines GROUP BY 1""",
    "stream_retries": f"SELECT stream_id, coalesce(min(seq) FILTER (type = 'error') < coalesce(min(seq) FILTER (type = 'chunk'), 9223372036854775807), false) AS again FROM {_EVENTS} GROUP BY 1",
    "stream_states": f"""
WITH e AS (SELECT stream_id, seq, type FROM {_EVENTS}), c AS (SELECT stream_id, CAST((min(seq) + max(seq)) // 2 AS BIGINT) AS seq, 'cancel' AS type FROM e WHERE CAST(stream_id AS BIGINT) % 2 = 0 GROUP BY 1),
a AS (SELECT * FROM e UNION ALL SELECT * FROM c), f AS (SELECT stream_id, arg_min(type, (seq, CASE type WHEN 'cancel' THEN 1 WHEN 'error' THEN 2 ELSE 3 END)) AS end_, min(seq) AS until FROM a WHERE type IN ('cancel', 'error', 'done') GROUP BY 1)
SELECT a.stream_id, CASE any_value(end_) WHEN 'cancel' THEN 'cancelled' WHEN 'error' THEN 'error' WHEN 'done' THEN 'idle' ELSE CASE WHEN count(*) FILTER (type = 'chunk') > 0 THEN 'streaming' ELSE 'pending' END END AS state, count(*) FILTER (type = 'chunk') AS chunks, max(seq) AS last_seq
FROM a LEFT JOIN f USING (stream_id) WHERE until IS NULL OR seq <= until GROUP BY 1""",
    "stream_progress": f"SELECT stream_id, seq, row_number() OVER w AS done, CAST(row_number() OVER w * 100 // count(*) OVER (PARTITION BY stream_id) AS INTEGER) AS percent FROM {_EVENTS} WHERE type = 'chunk' WINDOW w AS (PARTITION BY stream_id ORDER BY seq)",
    "stream_flushes": f"""
WITH c AS (SELECT stream_id, bytes, sum(bytes) OVER (PARTITION BY stream_id ORDER BY seq) AS through FROM {_EVENTS} WHERE type = 'chunk')
SELECT stream_id, CAST((through - bytes) // 40 AS BIGINT) AS flush, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY 1, 2""",
}
