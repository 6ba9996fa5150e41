"""Whitespace-aware text functions as native Spark Columns (S1-S3, S10, S11).

Python's ``str.split()``/``str.strip()`` treat every ``str.isspace`` character
as whitespace.  Spark's ``trim`` strips only U+0020 and Java's ``\\s`` misses
NBSP, so we spell the class out.  Over all BMP code points this class equals
``str.isspace``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of Python's str.isspace, in Java regex syntax.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NON_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
# The same class for DuckDB / RE2 (used by the SQL oracles).
WS_RE2 = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NON_WS_RE2 = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable).

    Catalyst may inline a projected column into a higher-order-function
    lambda, re-evaluating it per element; binding it as a lambda argument
    guarantees one evaluation per row.
    """
    return F.transform(F.array(value), body)[0]


def strip_ws(x: Column | str) -> Column:
    """SC16: ``str.strip()``."""
    return F.regexp_replace(_c(x), rf"\A{WS}+|{WS}+\z", "")


def is_blank(x: Column | str) -> Column:
    """True when NULL, empty or whitespace only (``not x.strip()``)."""
    return F.coalesce(~_c(x).rlike(NON_WS), F.lit(True))


def non_blank(x: Column | str) -> Column:
    """FL2/FL3: keep rows whose text has a non-whitespace character."""
    return F.coalesce(_c(x).rlike(NON_WS), F.lit(False))


def word_count(x: Column | str) -> Column:
    """SC10: ``len(x.split())`` as BIGINT (0 for '' and NULL)."""
    return F.coalesce(F.regexp_count(_c(x), F.lit(NON_WS + "+")), F.lit(0)).cast("bigint")


def rough_tokens(x: Column | str) -> Column:
    """SC11: ``int(len(x.split()) / 0.75)``; equals ``(4n) div 3`` below 300k words."""
    return F.floor(word_count(x) * 4 / 3).cast("bigint")


def words(x: Column | str) -> Column:
    """``x.split()`` as ARRAY<STRING> (whole text, no cap)."""
    return F.array_remove(F.split(_c(x), WS + "+"), "")


def first_words(x: Column | str, n: int) -> Column:
    """The first ``n`` of :func:`words` (all, if fewer); the rest of the text is not cut."""
    # at most one empty piece before the first word, and one piece for the rest
    return F.slice(F.array_remove(F.split(_c(x), WS + "+", n + 2), ""), 1, n)


def collapse_ws(x: Column | str) -> Column:
    """SC5: runs of two or more whitespace characters become one space (S11)."""
    return F.regexp_replace(_c(x), f"{WS}{{2,}}", " ")


EDGE_PUNCT = r"\A[\p{P}\p{S}]+|[\p{P}\p{S}]+\z"


def terms_from_words(w: Column) -> Column:
    """Lower-cased tokens with edge punctuation removed, from a word array."""
    return F.filter(F.transform(w, lambda x: F.lower(F.regexp_replace(x, EDGE_PUNCT, ""))), lambda x: x != "")


# A word from its first to its last character that is no punctuation or symbol.
TERM = r"[^\t-\r\x1c-\x20\x85\p{Z}\p{P}\p{S}](?:[^\t-\r\x1c-\x20\x85\p{Z}]*[^\t-\r\x1c-\x20\x85\p{Z}\p{P}\p{S}])?"


def lower_terms(x: Column | str) -> Column:
    """Lower-cased word tokens with edge punctuation removed (lexical metrics).

    The same as :func:`terms_from_words` of :func:`words`, cut in one pass over the text.
    """
    return F.transform(F.regexp_extract_all(_c(x), F.lit(f"({TERM})"), 1), F.lower)


_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill_template(template: str, **values: Column | str) -> Column:
    """SC13: ``template.format(**values)`` without re-reading substituted text (S10).

    The template is split on its placeholders once, on the driver, and the
    pieces are concatenated with the value columns, so a value containing
    ``{content}`` is never expanded again.  ``{{``/``}}`` escapes are honoured.
    """
    parts: list[Column] = []
    pos = 0
    text = template
    buf = []
    while pos < len(text):
        if text.startswith("{{", pos):
            buf.append("{")
            pos += 2
            continue
        if text.startswith("}}", pos):
            buf.append("}")
            pos += 2
            continue
        m = _PLACEHOLDER.match(text, pos)
        if m:
            if buf:
                parts.append(F.lit("".join(buf)))
                buf = []
            name = m.group(1)
            if name not in values:
                raise KeyError(name)
            parts.append(F.coalesce(_c(values[name]).cast("string"), F.lit("None")))
            pos = m.end()
            continue
        buf.append(text[pos])
        pos += 1
    if buf:
        parts.append(F.lit("".join(buf)))
    return F.concat(*parts) if parts else F.lit("")


def iso_timestamp(ts: Column | str) -> Column:
    """SC14: ``datetime.isoformat()`` of a UTC timestamp (fraction only when non-zero)."""
    c = _c(ts)
    return F.when(
        F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def stamp_name(prefix: str, ts: Column | str) -> Column:
    """SC15: ``f"{prefix}{ts:%Y%m%d_%H%M%S}"``."""
    return F.concat(F.lit(prefix), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


def fmt4(x: Column | str) -> Column:
    """SC19: ``f"{x:.4f}"``."""
    return F.format_string("%.4f", _c(x))


def to_number(x: Column | str) -> Column:
    """SC18: ``pd.to_numeric(errors='coerce')``: bad text becomes NULL, NaN becomes NULL (S9)."""
    d = _c(x).cast("string").try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))
