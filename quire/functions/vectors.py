"""Vector arithmetic on ARRAY<FLOAT> columns, computed in DOUBLE (SC20, SNK9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """SC20: cosine of two vectors; NULL when sizes differ or a norm is zero."""
    na, nb = norm(a), norm(b)
    return F.when(
        (F.size(_c(a)) == F.size(_c(b))) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)
    )


def search_score(cos: Column | str) -> Column:
    """TK1: the vector-index score for the cosine metric, ``(1 + cos) / 2``."""
    return (F.lit(1.0) + _c(cos)) / F.lit(2.0)


def contract_violation(a: Column | str, dim: int) -> Column:
    """SNK9: reason a vector breaks the index contract, NULL when it is valid."""
    c = _c(a)
    return (
        F.when(c.isNull(), F.lit("null"))
        .when(F.size(c) != dim, F.lit("wrong_size"))
        .when(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("bad_value"))
        .when(norm(c) == 0, F.lit("zero_norm"))
    )
