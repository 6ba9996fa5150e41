"""Model plug points (ML1, ML2, SC25) and deterministic offline stand-ins.

A chat model maps ``(system, user, max_tokens)`` columns to
``struct<value string, error string>`` (and more fields); an embedder maps a text column to an
``ARRAY<DOUBLE>``.  Remote models are wrapped with :func:`remote_chat` /
:func:`remote_embedder`: an iterator pandas UDF opens the client once per
task, calls it batch by batch and is marked non-deterministic so Spark never
re-evaluates it speculatively.  A failing call is tried again a bounded number
of times, after waits that double up to a bound; what still fails is an error
in the result, not of the job.  Write their output before fanning out
(:mod:`quire.operators.stored` keeps it over runs).

The stand-ins are plain Spark expressions (no Python worker):

* :class:`LeadChat` answers with the first ``n_words`` words of the user
  message (an extractive summary);
* :class:`SpreadChat` answers with words taken evenly from the whole message
  and a digest of all of it, and fails or stays empty on a fixed share;
* :class:`HashingEmbedder` is a hashed term-frequency vector, L2-normalised.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import _c, let, lower_terms, words

_MEASURED = [T.StructField("attempts", T.IntegerType()), T.StructField("started", T.TimestampType()), T.StructField("ended", T.TimestampType())]
#: result of a remote chat call, and of a text sent to a remote embedder
REMOTE_RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType()), *_MEASURED])
EMBED_RESULT = T.StructType([T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType()), *_MEASURED])


class LeadChat:
    """Deterministic extractive stand-in for a chat completion."""

    def __init__(self, n_words: int = 40):
        self.n_words = n_words

    def complete(self, system: Column | str, user: Column | str, max_tokens: int = 1_500) -> Column:
        n = min(self.n_words, max_tokens)
        value = F.array_join(F.slice(words(_c(user)), 1, n), " ")
        return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error"))


class SpreadChat:
    """Deterministic stand-in that depends on the whole message.

    The answer is ``n_words`` words at even distances over the message (all of
    them if it has fewer) and the first 8 hex digits of the message's md5.  A
    message whose digest starts with ``0`` fails (NULL and an error); one whose
    digest starts with ``f`` gets an empty answer.
    """

    def __init__(self, n_words: int = 39):
        self.n_words = n_words

    def complete(self, system: Column | str, user: Column | str, max_tokens: int = 1_500) -> Column:
        n = min(self.n_words, max_tokens - 1)

        def answer(w: Column) -> Column:
            size = F.size(w).cast("long")
            take = F.least(size, F.lit(n).cast("long"))
            picked = F.transform(
                F.when(take > 0, F.sequence(F.lit(0).cast("long"), take - 1)).otherwise(F.array().cast("array<long>")),
                lambda i: F.get(w, F.floor(i * size / take).cast("int")),
            )
            return F.array_join(F.concat(picked, F.array(F.substring(F.md5(_c(user)), 1, 8))), " ")

        first = F.substring(F.md5(_c(user)), 1, 1)
        failed = first == "0"
        value = F.when(failed, F.lit(None).cast("string")).when(first == "f", F.lit("")).otherwise(let(words(_c(user)), answer))
        return F.struct(value.alias("value"), F.when(failed, F.lit("refused")).alias("error"))


def _tried(call: Callable, attempts: int, wait: float, longest: float) -> tuple:
    """(value, error, attempts, started, ended) of a call, made again after errors."""
    started, error = pd.Timestamp.now(tz="UTC"), None
    for n in range(1, attempts + 1):
        try:
            return call(), None, n, started, pd.Timestamp.now(tz="UTC")
        except Exception as err:  # noqa: BLE001 - reported in the error column
            error = str(err) or type(err).__name__
            if n < attempts:
                time.sleep(min(wait * 2 ** (n - 1), longest))
    return None, error, attempts, started, pd.Timestamp.now(tz="UTC")


def remote_chat(call: Callable[[str, str, int], str | None], max_tokens: int = 1_500, attempts: int = 3, wait: float = 0.5, longest: float = 30.0):
    """Wrap a client function ``call(system, user, max_tokens) -> text`` as a chat model.

    A call is made at most ``attempts`` times, ``wait`` seconds after the first error, twice as long after
    each further one and at most ``longest``.  Errors become ``value=NULL, error=<message>`` (SC25) instead
    of failing the job; the result also tells the attempts and when the call began and ended.
    """

    @F.pandas_udf(REMOTE_RESULT)
    def _udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for system, user, limit in batches:
            rows = [_tried(partial(call, s, u, int(n)), attempts, wait, longest) for s, u, n in zip(system, user, limit)]
            yield pd.DataFrame(rows, columns=REMOTE_RESULT.names).astype({"started": "datetime64[us, UTC]", "ended": "datetime64[us, UTC]"})

    udf = _udf.asNondeterministic()

    class _Remote:
        def complete(self, system: Column | str, user: Column | str, max_tokens: int = max_tokens) -> Column:
            return udf(_c(system), _c(user), F.lit(max_tokens))

    return _Remote()


class HashingEmbedder:
    """Hashed term-frequency embedding, L2-normalised, ``ARRAY<DOUBLE>`` of ``dim``.

    Terms are those of :func:`quire.functions.text.lower_terms` (whitespace
    split, lower-cased, edge punctuation removed); a term's bucket is the
    first 8 hex digits of its md5, modulo ``dim``.  Runs as an Arrow-batched
    pandas UDF (numpy ``bincount`` per text), the same shape as a remote
    embedder.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def bucket(self, term: Column) -> Column:
        """The bucket rule as a Spark expression (for inspection and tests)."""
        return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(self.dim))

    def embed(self, text: Column | str) -> Column:
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def _embed(texts: pd.Series) -> pd.Series:
            import hashlib

            import numpy as np

            out = []
            cache: dict[str, int] = {}
            for terms in texts:
                if terms is None or len(terms) == 0:
                    out.append(None)
                    continue
                for t in set(terms).difference(cache):
                    cache[t] = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % dim
                idx = np.fromiter(map(cache.__getitem__, terms), np.int64, len(terms))
                counts = np.bincount(idx, minlength=dim).astype(np.float64)
                out.append(counts / np.sqrt(np.dot(counts, counts)))
            return pd.Series(out)

        # tokenisation stays in the JVM; Python only hashes and counts
        return _embed(lower_terms(text))


def remote_embedder(call: Callable[[list[str]], list[list[float]]], attempts: int = 3, wait: float = 0.5, longest: float = 30.0):
    """Wrap a batch client ``call(texts) -> vectors`` as an embedder (ML1).

    A batch is tried like a chat call; if it still fails its texts are sent one by one, so that only those
    that fail by themselves have no vector and an error (SC25).
    """

    @F.pandas_udf(EMBED_RESULT)
    def _udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            asked = texts.fillna("").tolist()
            whole = _tried(partial(call, asked), attempts, wait, longest) if asked else ([], None, 0, None, None)
            if whole[1] is None:
                rows = [(list(map(float, v)), None, *whole[2:]) for v in whole[0]]
            else:
                rows = []
                for text in asked:
                    value, *rest = _tried(partial(call, [text]), attempts, wait, longest)
                    rows.append((list(map(float, value[0])) if value else None, *rest))
            out = pd.DataFrame(rows, columns=EMBED_RESULT.names, dtype=object)
            yield out.astype({"attempts": "int32", "started": "datetime64[us, UTC]", "ended": "datetime64[us, UTC]"})

    udf = _udf.asNondeterministic()

    class _Remote:
        def embed_result(self, text: Column | str) -> Column:
            return udf(_c(text))

        def embed(self, text: Column | str) -> Column:
            return self.embed_result(text)["value"]

    return _Remote()
