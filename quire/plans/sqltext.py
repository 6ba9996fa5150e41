"""DuckDB spellings of the text functions, used only by the SQL oracles."""

from __future__ import annotations

import re

from quire.functions.text import NON_WS_RE2, WS_RE2

PUNCT_EDGE = r"\A[\p{P}\p{S}]+|[\p{P}\p{S}]+\z"


def lit(s: str) -> str:
    """A SQL string literal (newlines kept verbatim)."""
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NON_WS_RE2}+')"


def word_count(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def rough_tokens(x: str) -> str:
    return f"CAST((4 * len({words(x)})) // 3 AS BIGINT)"


def non_blank(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{NON_WS_RE2}'), false)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS_RE2}+|{WS_RE2}+\\z', '', 'g')"


def lead(x: str, n: int) -> str:
    return f"array_to_string({words(x)}[1:{n}], ' ')"


def reply(x: str, n: int) -> str:
    """The whole-message stand-in's answer to ``x``: evenly spread words and a digest; NULL or empty for a fixed share."""
    return (
        f"CASE substr(md5({x}), 1, 1) WHEN '0' THEN NULL WHEN 'f' THEN '' ELSE array_to_string(list_append("
        f"list_transform(range(least(len({words(x)}), {n})), lambda i: {words(x)}[(i * len({words(x)})) // least(len({words(x)}), {n}) + 1]),"
        f" substr(md5({x}), 1, 8)), ' ') END"
    )


def refused(x: str) -> str:
    return f"CASE WHEN substr(md5({x}), 1, 1) = '0' THEN 'refused' END"


def terms(x: str) -> str:
    """Lower-cased tokens without edge punctuation (list)."""
    return (
        f"list_filter(list_transform({words(x)}, lambda w: lower(regexp_replace(w, '{PUNCT_EDGE}', '', 'g'))),"
        f" lambda w: w <> '')"
    )


_PH = re.compile(r"\{(\w+)\}")


def fill(template: str, **cols: str) -> str:
    """``template.format(**cols)`` as a concatenation (placeholders read once)."""
    out, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            out.append(lit(template[pos : m.start()]))
        out.append(f"coalesce(CAST({cols[m.group(1)]} AS VARCHAR), 'None')")
        pos = m.end()
    if pos < len(template):
        out.append(lit(template[pos:]))
    return "(" + " || ".join(out) + ")"
