"""Token-bounded chunking (SC11, SC12, UN5).

A text whose rough token count fits in ``max_tokens`` stays one chunk,
unchanged.  Otherwise its words are cut into runs of
``n_words * max_tokens div tokens`` words, each joined by one space.  Whole
texts are processed; the work is per row (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import _c, let, words


def chunk_array(text: Column | str, max_tokens: int = 100_000) -> Column:
    """SC12: ARRAY<STRING> of chunks for one text."""
    if max_tokens < 2:
        # max_tokens=1 can make the chunk length 0; the reference then fails.
        raise ValueError("max_tokens must be >= 2")
    t = _c(text)

    def pieces(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        tokens = F.floor(n * 4 / 3).cast("bigint")
        chunk_len = F.floor(n * F.lit(max_tokens) / tokens).cast("int")
        n_chunks = F.ceil(n / chunk_len).cast("int")
        split = F.transform(
            F.sequence(F.lit(0), n_chunks - 1),
            lambda i: F.array_join(F.slice(w, i * chunk_len + 1, chunk_len), " "),
        )
        return F.when(tokens <= max_tokens, F.array(t)).otherwise(split)

    # words lie apart, so a text has at most one for two characters: short texts fit without being cut into words;
    # the word array of others is computed once per row and shared by the count and every chunk
    most = F.floor(F.floor((F.length(t) + 1) / 2) * 4 / 3)
    return F.when(t.isNotNull(), F.when(most <= max_tokens, F.array(t)).otherwise(let(words(t), pieces)))


def explode_chunks(df: DataFrame, text_col: str = "text", max_tokens: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """UN5: one row per chunk, ``chunk_no`` from 0 in text order."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(chunk_array(text_col, max_tokens)).alias("chunk_no", "chunk"))
