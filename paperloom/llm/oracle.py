"""SQL for the operators that SQL can express, for the same column names and values."""

from __future__ import annotations

#: The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# 40 hex digits are 160 bits: eight groups of 20 bits, four base32 characters each.
_DIGEST = " || ".join(
    f"substr('{BASE32}', (((('0x' || substr(h, {5 * group + 1}, 5))::BIGINT >> {shift}) & 31) + 1)::INTEGER, 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The control strings of the chat template, and what turns one text into a turn.
CONTROLS = ("<s>", "</s>", "<|start|>", "<|message|>", "<|end|>", "[INST]", "[/INST]")


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of the digits of a number: each byte goes in, then eight bits are divided out."""
    steps = f"flatten(list_transform(range(length({number}::VARCHAR)), lambda i: list_concat([ascii(substr({number}::VARCHAR, (i + 1)::INTEGER, 1)) + 1000::BIGINT], list_transform(range(8), lambda b: 0::BIGINT))))"
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda s, e: "
        "CASE WHEN e >= 1000 THEN xor(s, e - 1000) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))"
    )


def _controls_in(text: str) -> str:
    """Control strings in a text, with any backslashes after their first character."""
    quoted = "|".join("".join("\\" + x if x in "[|" else x for x in c[:1]) + "\\\\*" + "".join("\\" + x if x in "[]|" else x for x in c[1:]) for c in CONTROLS)
    return f"len(regexp_extract_all({text}, '{quoted}'))"


ORACLE: dict[str, str] = {
    "op3_arc_to_warc": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM p JOIN g USING (h)
    """,
    "op9_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, line, unnest(range(1, n + 1)) AS place, parts, n FROM (
                SELECT doc_id, NULL AS line, string_split(coalesce(text, ''), chr(10)) AS parts,
                       len(string_split(coalesce(text, ''), chr(10))) AS n
                FROM documents)
        ), keyed AS (
            SELECT doc_id, place, parts[place] AS line,
                   translate(trim(parts[place], {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k
            FROM lines
        ), often AS (
            SELECT k, max(doc_id) AS keeper FROM keyed
            WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT keyed.*, often.k IS NOT NULL AND doc_id <> keeper AS gone
            FROM keyed LEFT JOIN often ON keyed.k = often.k
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op12_prefix_trie": f"""
        WITH told AS (
            SELECT conv_id AS c, coalesce(text, '') AS text,
                   md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
                   coalesce(role, '') AS role, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), placed AS (
            SELECT c, said, strlen(text) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, said) AS place FROM told
        ), convs AS (
            SELECT c, {_crc32("c")} % 9 AS h, c - ((c % 5) + 5) % 5 AS base FROM placed GROUP BY c
        ), heads AS (
            SELECT convs.c, h, count(placed.c) AS n FROM convs LEFT JOIN placed ON placed.c = base AND place <= h GROUP BY convs.c, h
        ), steps AS (
            SELECT c, 0 AS depth, '' AS said, 0 AS size FROM convs
            UNION ALL
            SELECT convs.c, place, said, size FROM convs JOIN placed ON placed.c = base AND place <= h
            UNION ALL
            SELECT heads.c, place - h + n, said, size FROM heads JOIN placed USING (c) WHERE place > h
        ), paths AS (
            SELECT c, depth, size, string_agg(said, '') OVER (PARTITION BY c ORDER BY depth) AS path,
                   max(depth) OVER (PARTITION BY c) AS n FROM steps
        ), nodes AS (
            SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n), '')) AS ends_sha256
            FROM paths GROUP BY path, depth
        ), child AS (
            SELECT left(path, (32 * (depth - 1))::INTEGER) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
        ), below AS (
            SELECT a.path, sum((b.n_convs - 1) * b.size) AS saved, count(*) FILTER (WHERE child.n IS NULL) AS leaves
            FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) LEFT JOIN child ON child.path = b.path GROUP BY a.path
        )
        SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs,
               coalesce(child.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends_sha256
        FROM nodes JOIN below USING (path) LEFT JOIN child USING (path)
        LEFT JOIN nodes up ON nodes.depth > 0 AND up.path = left(nodes.path, (32 * (nodes.depth - 1))::INTEGER)
    """,
    "op13_chat_format": f"""
        WITH told AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (sum(length(role) + length(text) + {_controls_in("role")} + {_controls_in("text")} + {sum(len(c) for c in CONTROLS[2:5])})
                + {sum(len(c) for c in CONTROLS[:2])})::BIGINT AS formatted_chars
        FROM told GROUP BY conv_id
    """,
}
