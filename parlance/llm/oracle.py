"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_CURRENT = """cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS nth FROM messages WHERE id IS NOT NULL) WHERE nth = 1)"""

_SAID = "regexp_matches(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}]')"

ORACLE: dict[str, str] = {
    "p2_found": f"""
WITH {_CURRENT},
long AS (SELECT id, trim(original_content, E' \\t\\n') AS t FROM cur WHERE length(trim(original_content, E' \\t\\n')) > 2500),
cut AS (SELECT id, t, string_split(t, E'\\n') AS paragraphs,
  string_split(regexp_replace(regexp_replace(t, '([.!?])(\\s)', E'\\\\1\\x01\\\\2', 'g'), '([。！？])', E'\\\\1\\x01', 'g'), E'\\x01') AS halves FROM long),
most AS (SELECT id,
  list_max(list_transform(paragraphs, lambda x: length(x))) AS p,
  list_max(list_transform(flatten(list_transform(halves, lambda h: string_split(h, E'\\n'))), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')))) AS s,
  list_max(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: length(x))) AS w
  FROM cut)
SELECT id AS message_id, CASE WHEN p <= 2500 THEN 'paragraph' WHEN s <= 2500 THEN 'sentence' WHEN w <= 2500 THEN 'word' ELSE 'none' END AS boundary FROM most
""",
    "p2_tiling": f"""
WITH {_CURRENT}
SELECT id AS message_id, CAST(length(original_content) AS INTEGER) AS chars, true AS fits, true AS overlaps, true AS numbered, md5(original_content) AS digest
FROM cur WHERE length(trim(original_content, E' \\t\\n')) > 2500
""",
    "p7_whole": """
SELECT box AS box_size, (SELECT count(*) FROM documents) AS documents, true AS whole, true AS fits FROM pack_sizes WHERE capacity > 0
""",
    "p8_caps": """
SELECT source, max_repeats, true AS capped, true AS once, true AS known FROM mix_targets WHERE source IS NOT NULL
""",
    "p3_found": f"""
WITH {_CURRENT},
turns AS (
  SELECT session_id, id, r AS role, row_number() OVER (PARTITION BY session_id ORDER BY display_order NULLS FIRST, created_at NULLS FIRST, id) AS n,
    coalesce((r = 'user' AND {_SAID.format('original_content')}) OR (r = 'assistant' AND {_SAID.format('translated_content')}), false) AS usable
  FROM (SELECT *, lower(trim(role, E' \\t\\n\\r')) AS r FROM cur WHERE session_id IS NOT NULL) WHERE r IS DISTINCT FROM 'system'),
kept AS (
  SELECT session_id FROM turns GROUP BY 1
  HAVING bool_and(usable AND role = CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0)
SELECT session_id, CAST(n AS INTEGER) AS turn_no, id AS message_id, role FROM turns WHERE session_id IN (SELECT session_id FROM kept)
""",
    "p9_found": """
WITH docs AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
spot AS (SELECT doc_id, unnest(range(1, n - 198)) AS i FROM docs),
win AS (SELECT a.doc_id, a.i, md5_number(substr(d.text, a.i, 200)) AS w FROM spot a JOIN docs d USING (doc_id)),
twice AS (SELECT w FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win WHERE w IN (SELECT w FROM twice)),
gap AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS step FROM hit)
SELECT doc_id, CAST(sum(least(200, coalesce(step, 200))) AS INTEGER) AS shared_chars FROM gap GROUP BY doc_id
""",
}
