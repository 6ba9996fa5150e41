"""HTML section cleaning as a native regexp chain (SC1-SC5, PR1).

Semantics reproduced (parser text extraction with a space separator):
comments and doctype are dropped, ``<script>``/``<style>`` lose their content,
``<sup class="reference">`` citations are dropped, every other tag separates
text nodes by one space, entities are decoded once, outer whitespace is
stripped and runs of two or more whitespace characters collapse to a space.

Limits of the short chain :func:`clean_html`: a ``sup.reference`` that holds
another ``sup`` is cut at the first ``</sup>``; named entities outside ``ENTITIES``
and numeric references other than those listed stay as written.
:func:`clean_html_exact` has no such limits: rows that need it go through a fold
over the ``sup`` tags and through the whole table of references, both Spark
expressions.
"""

from __future__ import annotations

import json
from html.entities import html5 as HTML5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _c, collapse_ws, let, strip_ws

# The element patterns removed before text extraction.
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
SUP_REFERENCE = (
    r"(?is)<sup\b[^>]*\bclass\s*=\s*(?:\"(?:[^\"]*\s)?reference(?:\s[^\"]*)?\"|'(?:[^']*\s)?reference(?:\s[^']*)?')"
    r"[^>]*>.*?</sup\s*>"
)
TAG = r"(?s)</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>|<\?[^>]*>"

# HTML entities decoded, as (pattern, replacement).  Names that
# HTML allows without the trailing semicolon (legacy names) take it as optional.
# ``&amp;`` is decoded last so ``&amp;lt;`` becomes ``&lt;``, not ``<``.
ENTITIES: list[tuple[str, str]] = [
    ("&lt;?", "<"),
    ("&gt;?", ">"),
    ("&quot;?", '"'),
    ("&nbsp;?", "\u00a0"),
    ("&copy;?", "©"),
    ("&reg;?", "®"),
    ("&middot;?", "·"),
    ("&apos;", "'"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&#160;", "\u00a0"),
    ("&amp;?", "&"),
]


def remove_hidden(html: Column | str) -> Column:
    """SC1 + comments: drop elements that hold no text of the page."""
    c = _c(html)
    for pat in (COMMENT, SCRIPT, STYLE):
        c = F.regexp_replace(c, pat, " ")
    return c


def remove_noise(html: Column | str) -> Column:
    """SC1 + SC2 + comments: drop elements whose text must not be kept."""
    return F.regexp_replace(remove_hidden(html), SUP_REFERENCE, " ")


def strip_tags(html: Column | str) -> Column:
    """SC3/SC4: every remaining tag (links unwrapped) becomes a separating space."""
    return F.regexp_replace(_c(html), TAG, " ")


def decode_entities(text: Column | str) -> Column:
    c = _c(text)
    for pat, rep in ENTITIES:
        c = F.regexp_replace(c, pat, rep)
    return c


def clean_html(html: Column | str) -> Column:
    """SC1-SC5: the whole chain; output equals parser text extraction + ``\\s{2,}`` collapse."""
    return collapse_ws(strip_ws(decode_entities(strip_tags(remove_noise(html)))))


def page_title(url: Column | str) -> Column:
    """PR1: text after the last ``/wiki/``; the whole URL when absent."""
    return F.substring_index(_c(url), "/wiki/", -1)


def _sql_replace(x: str, pat: str, rep: str) -> str:
    p = pat.replace("'", "''")
    r = rep.replace("'", "''")
    return f"regexp_replace({x}, '{p}', '{r}', 'g')"


def sql_remove_hidden(col: str) -> str:
    """:func:`remove_hidden` for DuckDB."""
    x = col
    for pat in (COMMENT, SCRIPT, STYLE):
        x = _sql_replace(x, pat, " ")
    return x


def sql_clean_html(col: str) -> str:
    """The same chain for DuckDB (RE2: no backreferences, ``\\x{85}`` spelling)."""
    from quire.functions.text import WS_RE2

    x = _sql_replace(_sql_replace(sql_remove_hidden(col), SUP_REFERENCE, " "), TAG, " ")
    for pat, rep in ENTITIES:
        x = _sql_replace(x, pat, rep)
    x = _sql_replace(x, rf"\A{WS_RE2}+|{WS_RE2}+\z", "")
    return _sql_replace(x, f"{WS_RE2}{{2,}}", " ")


# --------------------------------------------------------------------------- nested citations, any reference

SUP_START = r"(?i)(?=<sup[\s/>])|(?=</sup[\s>])"
SUP_OPEN = r"(?i)^<sup[\s/>]"
SUP_CLOSE = r"(?i)^</sup[^>]*>"
# the class attribute of a start tag holds the word "reference"
REFERENCE_CLASS = r"""(?is)^<sup\b(?:[^>"']|"[^"]*"|'[^']*')*?[\s"'/]class\s*=\s*(?:"(?:[^"]*\s)?reference(?:\s[^"]*)?"|'(?:[^']*\s)?reference(?:\s[^']*)?'|reference(?=[\s/>]))"""


def drop_citations(html: Column | str) -> Column:
    """SC2 with depth: every ``sup.reference`` element goes whole, whatever ``sup`` it holds; an unclosed one reaches to the end.

    The text is cut before every ``sup`` tag; a fold over the pieces counts how deep inside a citation each
    one is and keeps those outside.
    """
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        depth, kept = state["depth"], state["kept"]
        opens, closes = piece.rlike(SUP_OPEN), piece.rlike(SUP_CLOSE)
        inside = depth > 0
        new = (
            F.when(inside & opens, depth + 1)
            .when(inside & closes, depth - 1)
            .when(~inside & opens & piece.rlike(REFERENCE_CLASS), F.lit(1))
            .otherwise(depth)
        )
        # what follows the tag that ends a citation is outside again
        text = F.when(inside & closes & (depth == 1), F.concat(F.lit(" "), F.regexp_replace(piece, SUP_CLOSE, ""))).when(new == 0, piece)
        return F.struct(new.alias("depth"), F.when(text.isNotNull(), F.concat(kept, F.array(text))).otherwise(kept).alias("kept"))

    pieces = F.split(_c(html), SUP_START)
    return F.array_join(F.aggregate(pieces, start, step, lambda s: s["kept"]), "")


# Names and the text they stand for come with the language's own table of HTML 5; those without
# the semicolon may stand before other text, the longest first.
_LEGACY = sorted((n for n in HTML5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Fixed rule of HTML 5 for numeric references to C1 controls: the characters of Windows-1252.
_C1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _character(number: Column) -> Column:
    """Text of a numeric reference; ``number`` is NULL beyond any character."""
    c1 = F.create_map(*[F.lit(x) for n, t in _C1.items() for x in (n, t)])
    below = F.pmod(number, F.lit(0x10000))
    no_text = (
        number.between(0x1, 0x8) | number.between(0xE, 0x1F) | (number == 0xB) | (number == 0x7F) | number.between(0xFDD0, 0xFDEF) | (below >= 0xFFFE)
    )
    return (
        F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(number.between(0x80, 0x9F), F.element_at(c1, number.cast("int")))
        .when(no_text, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def decode_references(text: Column | str) -> Column:
    """SC4: every character reference, numeric or named, decoded once - as the HTML 5 rules have it."""
    # a literal: the optimizer evaluates it once
    names = F.from_json(F.lit(json.dumps(HTML5)), "map<string,string>")
    legacy = "^(" + "|".join(_LEGACY) + ")"

    def number_of(token: Column) -> Column:
        # at most seven digits can name a character; leading zeros count for nothing
        digits = F.regexp_extract(token, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
        base16 = token.rlike("^#[xX]")
        value = F.when(base16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        return F.when(F.length(digits) == 0, F.lit(0).cast("long")).when(F.length(digits) <= 7, value)

    def named(token: Column, part: Column) -> Column:
        whole, prefix = F.try_element_at(names, token), F.regexp_extract(token, legacy, 1)
        return (
            F.when(whole.isNotNull(), F.concat(whole, F.substr(part, F.length(token) + 1)))
            .when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substr(part, F.length(prefix) + 1)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def decoded(part: Column) -> Column:
        def of(token: Column) -> Column:
            return (
                F.when(token == "", F.concat(F.lit("&"), part))
                .when(token.startswith("#"), F.concat(_character(number_of(token)), F.substr(part, F.length(token) + 1)))
                .otherwise(named(token, part))
            )

        return let(F.regexp_extract(part, _REFERENCE, 1), of)

    parts = F.split(_c(text), "&", -1)
    joined = let(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), decoded), "")))
    return F.when(F.contains(_c(text), F.lit("&")), joined).otherwise(_c(text))


# A character reference the short chain does not decode: '&' + name or '#',
# other than the names listed in ENTITIES (numeric ones only as listed).
_KNOWN = "|".join(p.lstrip("&").rstrip("?").replace(";", "") for p, _ in ENTITIES if not p.startswith("&#"))
OTHER_ENTITY = rf"&(?!(?:{_KNOWN})\b|#39;|#x27;|#160;)(?:[A-Za-z]|#)"


def clean_html_exact(html: Column | str) -> Column:
    """SC1-SC5 with nested citations removed whole and every reference decoded, all in Spark expressions.

    Rows without a ``sup`` and without a reference beyond ``ENTITIES`` use the short chain.
    """
    c = _c(html)
    full = collapse_ws(strip_ws(decode_references(strip_tags(drop_citations(remove_hidden(c))))))
    hard = F.coalesce(c.rlike(r"(?i)<sup[\s/>]") | c.rlike(OTHER_ENTITY), F.lit(False))
    return F.when(hard, full).otherwise(clean_html(c))
