"""Parts of the comparison SQL (DuckDB)."""

from __future__ import annotations

from engram.functions.text import JS_SPACE

SPACE = " || ".join(f"chr({ord(c)})" for c in JS_SPACE)
LINES = "(SELECT DISTINCT * FROM mixed_session)"


def trimmed(c: str) -> str:
    return f"trim({c}, {SPACE})"


def instant(c: str) -> str:
    return rf"epoch_us(CAST(CASE WHEN regexp_matches({c}, '(Z|z|[+-]\d\d:?\d\d)$') THEN {c} ELSE {c} || 'Z' END AS TIMESTAMPTZ))"


def message_text(c: str) -> str:
    block = "CASE WHEN json_extract_string(b, '$.type') = 'text' AND json_type(b, '$.text') = 'VARCHAR' THEN json_extract_string(b, '$.text') END"
    blocks = f"list_filter(list_transform(json_extract({c}, '$[*]'), lambda b: {block}), lambda t: t IS NOT NULL AND {trimmed('t')} <> '')"
    return f"""CASE WHEN NOT coalesce(json_valid({c}), false) THEN ''
        WHEN json_type({c}) = 'VARCHAR' THEN {trimmed(f"json_extract_string({c}, '$')")}
        WHEN json_type({c}) = 'ARRAY' THEN {trimmed(f"array_to_string({blocks}, chr(10))")} ELSE '' END"""


def visible_text(c: str) -> str:
    blocks = f"list_transform(list_filter(json_extract({c}, '$[*]'), lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: coalesce(json_extract_string(b, '$.text'), ''))"
    return f"""CASE WHEN NOT coalesce(json_valid({c}), false) THEN ''
        WHEN json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$')
        WHEN json_type({c}) = 'ARRAY' THEN array_to_string({blocks}, chr(10)) ELSE '' END"""


#: Entries of session files (of rows with one id the last), with their text.
ENTRIES = f"""(SELECT source_uri, id, parentId, line_number, type, message.role AS role, {instant('timestamp')} AS said_at,
    CASE WHEN type = 'message' THEN {message_text('message.content')} ELSE '' END AS text
    FROM {LINES} WHERE type IS DISTINCT FROM 'session' AND id <> ''
    QUALIFY row_number() OVER (PARTITION BY source_uri, id ORDER BY line_number DESC) = 1)"""

#: The current version of every chunk.
CURRENT = f"""(SELECT * FROM source_chunks
    QUALIFY row_number() OVER (PARTITION BY project_id, chunk_id ORDER BY {instant('updated_at')} DESC NULLS LAST, text NULLS FIRST, source_kind NULLS FIRST) = 1)"""

#: What is indexed of session files.
PARSED = f"""(SELECT source_uri, id AS entry_id, nullif(parentId, '') AS parent_id, line_number, nullif(timestamp, '') AS timestamp, session_cwd AS cwd,
    message.role AS role, {message_text('message.content')} AS text
    FROM (SELECT *, last_value(CASE WHEN type = 'session' THEN nullif(cwd, '') END IGNORE NULLS)
        OVER (PARTITION BY source_uri ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_cwd FROM {LINES})
    WHERE type = 'message' AND message.role IN ('user', 'assistant') AND id <> '' AND {message_text('message.content')} <> '')"""

VISIBLE = f"""(SELECT DISTINCT source_uri, line_number AS "lineNumber", coalesce(id, '') AS "entryId", coalesce(parentId, '') AS "parentId",
    coalesce(timestamp, '') AS timestamp, message.role AS role, {visible_text('message.content')} AS text
    FROM mixed_session WHERE type = 'message' AND message.role IN ('user', 'assistant') AND length({visible_text('message.content')}) > 0)"""

CHAIN = f"""(WITH RECURSIVE entries AS (SELECT source_uri, id, parentId, type, line_number FROM {LINES} WHERE id <> ''
        QUALIFY row_number() OVER (PARTITION BY source_uri, id ORDER BY line_number DESC) = 1),
    leaf AS (SELECT source_uri, max_by(id, line_number) AS id FROM {LINES} WHERE type = 'message' AND id <> '' GROUP BY source_uri),
    walk(source_uri, id, parentId) AS (SELECT e.source_uri, e.id, e.parentId FROM entries e JOIN leaf USING (source_uri, id)
        UNION SELECT e.source_uri, e.id, e.parentId FROM walk w JOIN entries e ON e.source_uri = w.source_uri AND e.id = w.parentId)
    SELECT source_uri, id AS entry_id FROM walk)"""
