"""Personal data by weak supervision, with DataFrame expressions only.

Candidate spans of four kinds (email, ip, card, phone) come from the strict
patterns and from wider ones (written-out "(at)" and "[.]", national phone
numbers, dotted card numbers).  Four labelers vote on each candidate:

* regex: it has the strict form and passes the kind's check;
* form: the kind's check holds (Luhn sum, part sizes, digit count, known suffix);
* context: a cue word of the kind stands shortly before it;
* edges: no letter or digit touches it.

Spark counts the vote patterns over all candidates (at most ``PATTERNS`` of
them, whatever the table's size).  Expectation-maximisation on those counts
estimates each labeler's hit and false-alarm rate and each pattern's
probability; a logistic span classifier on votes, kind and length is then
trained on these probabilities and applied as a SQL expression.  Strict spans
that pass their check always stay; the classifier decides on the wider ones
that overlap none of them.

Defined results: null and empty texts have no spans; each row is judged by
itself, so repeated rows, null ids and other columns do not matter.  Offsets
count code points; ends are exclusive.  All patterns run in linear time on
runs of any length (possessive, and anchored to the run's start).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")
#: (kind, votes of four labelers, length class): the most patterns there can be
PATTERNS = len(KINDS) * 2**4 * 3

# The strict patterns (fixed values), in a form that never scans a run twice: a match starts where its
# run starts or where the last match ended.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
STRICT = {
    "email": _LOCAL + r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": _LOCAL + r"\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|[(\[]dot[)\]])[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}+(?![0-9./_])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
}
# A text without these has no match of the kind.
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_WIDE_HINT = {"email": r"[(\[]at[)\]]", "ip": r"[0-9][(\[]", "card": r"[0-9]{4}[./_][0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
_CUES = {
    "email": "mail|contact|write|address|reach",
    "ip": "ip|host|server|node|addr",
    "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|tel|call|mobile|fax|dial|number",
}
_SUFFIXES = "com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|eu|ch|at|nl"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda t, k: t + F.when((n - k) % 2 == 0, F.substring(digits, k, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, k, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_replace(value, r"[^0-9]+", ".").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _form(kind: str, value: Column) -> Column:
    return F.lower(value).rlike(rf"(?:{_SUFFIXES})$") if kind == "email" else _passes(kind, value)


def _matches(text: Column, pattern: str, hint: str, make: Callable[[Column, Column, Column], Column], empty: Column) -> Column:
    """Every match as ``make(start, end, value)``: what lies between the matches gives their places."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    folded = F.aggregate(
        F.filter(parts, lambda p: p.m.isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["m"])).alias("at"),
            F.concat(acc["out"], F.array(make(acc["at"] + p["gap"], acc["at"] + p["gap"] + F.length(p["m"]), p["m"]))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(hint), folded).otherwise(empty)


_SPAN = "array<struct<start:int,kind:int,end:int,strict:boolean,f_regex:boolean,f_form:boolean,f_context:boolean,f_edges:boolean,long:int>>"


def _spans(text: Column, kind: str, strict: bool) -> Column:
    k = KINDS.index(kind)

    def make(start: Column, end: Column, value: Column) -> Column:
        before = F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
        after = F.substring(text, end + 1, F.lit(1))
        ok = _passes(kind, value) if strict else F.lit(False)
        return F.struct(
            start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), ok.alias("strict"), ok.alias("f_regex"),
            _form(kind, value).alias("f_form"), F.lower(before).rlike(_CUES[kind]).alias("f_context"),
            (~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]")).alias("f_edges"),
            F.when(end - start < 12, 0).when(end - start < 20, 1).otherwise(2).alias("long"),
        )

    empty = F.array().cast(_SPAN)
    return _matches(text, (STRICT if strict else WIDE)[kind], (_HINT if strict else _WIDE_HINT)[kind], make, empty).cast(_SPAN)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__base`` (checked strict spans), ``__failed`` (other strict matches) and ``__wide``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__text", text)
    out = out.withColumn("__all", F.concat(*[_spans(F.col("__text"), k, True) for k in KINDS]))
    out = out.withColumn("__more", F.concat(*[_spans(F.col("__text"), k, False) for k in KINDS]))
    free = lambda w: ~F.exists("__base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    return (
        out.withColumn("__base", F.array_sort(F.filter("__all", lambda s: s["strict"])))
        .withColumn("__failed", F.filter("__all", lambda s: ~s["strict"]))
        .withColumn("__wide", F.filter("__more", free))
        .drop("__all", "__more")
    )


_VOTES = ("f_regex", "f_form", "f_context", "f_edges")


def fit(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 60) -> tuple[dict[str, tuple[float, float]], list[float]]:
    """Labelers' (hit, false-alarm) rates by EM, and the span classifier's weights.

    ``counts``: (kind, votes, length class, how many).  The context labeler
    abstains when it finds no cue, so only its positive votes are evidence
    against a span's absence at full weight.  Rates stay within 0.02 and 0.98.
    """
    hit, alarm, prior = [0.8] * 4, [0.2] * 4, 0.5
    clip = lambda p: min(0.98, max(0.02, p))
    post = []
    for _ in range(rounds):
        post = []
        for _, votes, _, _ in counts:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                odds += math.log(hit[j] / alarm[j]) if v else 0.0 if j == 2 else math.log((1 - hit[j]) / (1 - alarm[j]))
            post.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        yes = sum(p * c[3] for p, c in zip(post, counts))
        no = sum((1 - p) * c[3] for p, c in zip(post, counts))
        prior = clip((yes + 1) / (yes + no + 2))
        for j in range(4):
            # one pseudo-count of each outcome; a labeler is taken to be no worse than chance
            h = clip((sum(p * c[3] for p, c in zip(post, counts) if c[1][j]) + 1.6) / (yes + 2))
            a = clip((sum((1 - p) * c[3] for p, c in zip(post, counts) if c[1][j]) + 0.4) / (no + 2))
            hit[j], alarm[j] = max(h, a), min(h, a)
    rows = [([1.0, *map(float, votes), *(float(kind == k) for k in range(len(KINDS))), float(size == 1), float(size == 2)], p, math.log1p(n)) for (kind, votes, size, n), p in zip(counts, post)]
    w = [0.0] * (7 + len(KINDS))
    for _ in range(400):
        grad = [0.01 * x for x in w]
        for x, p, n in rows:
            d = n * (1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x)))))) - p)
            grad = [g + d * b for g, b in zip(grad, x)]
        step = 0.5 / (sum(n for _, _, n in rows) + 1)
        w = [a - step * g for a, g in zip(w, grad)]
    return dict(zip(_VOTES, zip(hit, alarm))), w


def train(found: DataFrame) -> list[float]:
    """Classifier weights from the vote patterns of all candidates in ``candidates()`` output."""
    rows = found.select(F.explode(F.concat("__base", "__failed", "__wide")).alias("s"))
    counted = rows.groupBy("s.kind", *[f"s.{v}" for v in _VOTES], "s.long").count().collect()  # at most PATTERNS rows
    return fit(sorted((r.kind, tuple(int(r[v]) for v in _VOTES), r.long, r["count"]) for r in counted))[1]


def _accepted(s: Column, w: list[float]) -> Column:
    bits = [F.lit(1.0), *[s[v].cast("double") for v in _VOTES], *[(s["kind"] == k).cast("double") for k in range(len(KINDS))], (s["long"] == 1).cast("double"), (s["long"] == 2).cast("double")]
    total = bits[0] * w[0]
    for b, x in zip(bits[1:], w[1:]):
        total = total + b * F.lit(x)
    return total > 0


def detect(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of ``(start, kind, end)``, sorted; kind names an entry of ``KINDS``."""
    found = candidates(docs, text_col)
    w = train(found.select("__base", "__failed", "__wide")) if weights is None else weights
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return (
        found.withColumn("base_spans", plain(F.col("__base")))
        .withColumn("spans", F.array_sort(F.concat("base_spans", plain(F.filter("__wide", lambda s: _accepted(s, w))))))
        .drop("__text", "__base", "__failed", "__wide")
    )


def joined(spans: str) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind as listed."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: str) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    name = F.array(*map(F.lit, KINDS))
    done = F.aggregate(
        F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(name, s["kind"] + 1), F.lit("]"))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
