"""The named queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op4_chat_formatting": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
)
SELECT
    conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(
        length('<turn >' || '</turn>' || chr(10))
        + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'))
        + length(replace(replace(text, '\', '\\'), '<', '\l'))
    ) AS BIGINT) AS formatted_chars
FROM turns
GROUP BY conv_id
""",
    "op8_line_dedup": r"""
WITH page AS (
    SELECT row_number() OVER () AS page, doc_id, source, text FROM documents
),
line AS (
    SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM page WHERE text IS NOT NULL
),
keyed AS (
    SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line
),
held AS (
    SELECT source, k, count(DISTINCT page) AS n FROM keyed WHERE k <> '' GROUP BY source, k
),
host AS (
    SELECT source, count(*) AS pages FROM page GROUP BY source
),
furniture AS (
    SELECT held.source, held.k FROM held JOIN host ON held.source IS NOT DISTINCT FROM host.source
    WHERE held.n >= 5 AND held.n > host.pages * 0.1
),
judged AS (
    SELECT keyed.page, keyed.place, keyed.line, keyed.k <> '' AS filled, furniture.k IS NOT NULL AS bad
    FROM keyed LEFT JOIN furniture ON keyed.source IS NOT DISTINCT FROM furniture.source AND keyed.k = furniture.k
),
summed AS (
    SELECT
        page,
        count(*) FILTER (WHERE filled) AS n_lines,
        count(*) FILTER (WHERE bad) AS n_bad,
        coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT bad), '') AS kept
    FROM judged GROUP BY page
)
SELECT
    page.doc_id,
    page.source,
    CASE WHEN coalesce(n_bad, 0) IN (0, n_lines) THEN page.text ELSE kept END AS text,
    coalesce(n_lines, 0) AS n_lines,
    CASE WHEN n_bad = n_lines THEN 0 ELSE coalesce(n_bad, 0) END AS n_dropped
FROM page LEFT JOIN summed ON page.page = summed.page
""",
}
