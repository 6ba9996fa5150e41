"""Hierarchical language identification.

A text is first given a language family, then a language of that family:

* features: hashed counts of letter pairs and triples of the whole text (any
  non-letter ASCII byte is a gap), square-rooted and scaled to unit length;
* families are learned, not listed: average linkage on the cosine of the
  languages' mean features joins L languages into ceil(sqrt(L)) families;
* families are told apart by linear classifiers, one against the other for
  each pair, and so are the languages within a family: a linear support
  vector machine (squared hinge loss, ridge penalty) for each pair, trained
  on a bounded sample and scaled to a probability.

A language can also be refused (``reject``).  The cost of a text under a
language is the mean of ``-log p`` over its letter pairs and triples, ``p``
being their shares in the language's sample.  Without any language a feature
costs ``log SIZE``.  A text is of no recognised language if it costs more under
its winner than that, or than the ``QUANTILE`` of the language's own labelled
sample if this is more, by two standard errors (texts of few features err).

The sample: about ``sample`` rows of each language, by a hash of the row's id;
its size does not grow with the table.  Every text is judged whole.

Defined results: a text that is null or has no letter is ``und`` with score 0;
rows are returned as they come (repeated and null ids too); with no usable
training row every text is ``und``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.words import buffers, lowered, mix, pieces

SIZE = 4096
UNKNOWN = "und"
#: this share of a language's labelled sample is never refused
QUANTILE = 0.99
_SLOT2 = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(SIZE)).astype(np.int32)
_GAP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, past the last, float32 unit rows) of the texts, piece by piece."""
    data, offsets = buffers(texts)
    for a, b in pieces(offsets, most=1000):  # bounds the rows of counts held at once
        raw = data[offsets[a] : offsets[b]]
        # one gap between texts; nothing spans two texts
        row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(offsets[a : b + 1]))
        low = lowered(raw, plain=True)
        low[_GAP[low]] = 32
        out = np.zeros(((b - a), SIZE), np.float32)
        if len(low) > 2:
            same = (row[:-2] == row[2:]) & (low[1:-1] != 32)
            x, y, z = (low[k : len(low) - 2 + k][same].astype(np.int64) for k in range(3))
            at = row[:-2][same] * SIZE
            slot3 = (mix(((x << 16) | (y << 8) | z).astype(np.uint64) + np.uint64(1 << 32)) % np.uint64(SIZE)).astype(np.int64)
            counts = np.bincount(at + slot3, minlength=out.size) + np.bincount(at + _SLOT2[(x << 8) | y], minlength=out.size)
            out = np.sqrt(counts.reshape(out.shape)).astype(np.float32)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        yield a, b, out


def _svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear machine: squared hinge loss, accelerated gradient descent.

    Classes weigh the same whatever their sizes.  The slope turns a margin
    into the log-odds of the positive class (fitted on the same rows).
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    rate = 1 / (2 * 2.0 + ridge)  # rows have length 1 and the bias adds 1
    for t in range(steps):
        margin = y * (x @ vw + vb)
        g = -2 * weight * y * np.maximum(0, 1 - margin)
        nw, nb = vw - rate * (x.T @ g + ridge * vw), vb - rate * float(g.sum())
        k = t / (t + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    m, slope = y * (x @ w + b), 1.0
    for _ in range(50):  # one-dimensional Newton steps on the logistic loss, kept in a sane range
        p = 1 / (1 + np.exp(-np.clip(slope * m, -30, 30)))
        slope = float(np.clip(slope + (weight * m * (1 - p)).sum() / ((weight * m * m * p * (1 - p)).sum() + 1e-3), 0.5, 12))
    return w, b, slope


def _families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Average-linkage clusters of the languages by cosine of their mean features."""
    groups = [[x] for x in sorted(means)]
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in means.items()}
    near = lambda a, b: float(np.mean([unit[x] @ unit[y] for x in a for y in b]))
    while len(groups) > math.ceil(math.sqrt(len(means))):
        _, i, j = max((near(a, b), -i, -j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        groups[-i] = sorted(groups[-i] + groups[-j])
        del groups[-j]
    return groups


class LanguageModel:
    """Families, the machines between them, and the machines inside each."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        means = {k: x[langs == k].mean(axis=0) for k in sorted(set(langs.tolist()))}
        self.groups = _families(means)
        self.cost, self.level, self.spread = {}, {}, {}
        for k in means:
            mine = np.square(x[langs == k])
            rows = float(mine.sum())  # rows with a feature
            p = (mine.sum(axis=0, dtype=np.float64) + 1 / SIZE) / (rows + 1)
            self.cost[k] = -np.log(p).astype(np.float32)
            self.spread[k] = float(np.sqrt(max(p @ np.log(p) ** 2 - (p @ np.log(p)) ** 2, 0)))
            self.level[k] = max(math.log(SIZE), float(np.quantile(mine @ self.cost[k], QUANTILE)))
        of = {lang: i for i, g in enumerate(self.groups) for lang in g}
        family = np.array([of[k] for k in langs.tolist()], np.int64)
        pair = lambda a, b: _svm(np.concatenate([x[a], x[b]]), np.repeat(np.float32([1, -1]), [a.sum(), b.sum()]))
        self.between = {(i, j): pair(family == i, family == j) for i, j in itertools.combinations(range(len(self.groups)), 2)}
        self.within = [{(i, j): pair(langs == g[i], langs == g[j]) for i, j in itertools.combinations(range(len(g)), 2)} for g in self.groups]

    @staticmethod
    def _vote(x: np.ndarray, machines: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner and its weakest pairwise probability: most duels won, ties to the larger sum of probabilities."""
        won, weakest = np.zeros((len(x), n)), np.ones((len(x), n))
        for (i, j), (w, b, slope) in machines.items():
            p = 1 / (1 + np.exp(-np.clip(slope * (x @ w + b), -30, 30)))
            won[:, i] += (p >= 0.5) + p / (10 * n)
            won[:, j] += (p < 0.5) + (1 - p) / (10 * n)
            weakest[:, i] = np.minimum(weakest[:, i], p)
            weakest[:, j] = np.minimum(weakest[:, j], 1 - p)
        best = won.argmax(axis=1)
        return best, weakest[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self._vote(x, self.between, len(self.groups))
        lang = np.empty(len(x), object)
        for f, members in enumerate(self.groups):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, p = self._vote(x[rows], self.within[f], len(members))
                lang[rows] = np.array(members, object)[best]
                score[rows] *= p
        return lang, score

    def recognised(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Which texts their language explains; a text without a feature has nothing against it."""
        out = np.ones(len(x), bool)
        for k in self.cost:
            rows = np.flatnonzero(lang == k)
            error = self.spread[k] / np.sqrt(np.maximum((x[rows] > 0).sum(axis=1), 1))
            out[rows] = np.square(x[rows]) @ self.cost[k] <= self.level[k] + 2 * error
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", sample: int = 600) -> LanguageModel | None:
    """Fit on about ``sample`` rows of each language; None if no row has text and language.

    A row is in the sample if a hash of its key (and text length, so that
    null or repeated keys do not matter) falls under the language's share.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key).alias("key")).where(
        "text is not null and lang is not null and lang <> 'und'"
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.length("text")), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n) * (1 << 30))) for k, n in sizes.items()])
    chosen = rows.where((draw < share) & F.col("text").rlike(r"\p{L}")).select("text", "lang")

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b, x in features(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), part.column(1).slice(a, b - a)], ["x", "lang"])

    got = chosen.mapInArrow(digest, "x binary, lang string").toPandas()
    if not len(got):
        return None
    got = got.iloc[np.lexsort((got.x.to_numpy(), got.lang.to_numpy()))]
    x = np.empty((len(got), SIZE), np.float32)
    for k, v in enumerate(got.x):
        x[k] = np.frombuffer(v, np.float16)
    langs = got.lang.to_numpy(object)
    del got
    return LanguageModel(x, langs)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), reject: bool = False) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` for every row; with ``reject``, unrecognised texts are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    letters: Column = F.coalesce(F.col("__text").rlike(r"\p{L}"), F.lit(False))
    names = [*keep, "lang_pred", "score"]

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            texts, ok = part.column(len(keep)), np.asarray(part.column(len(keep) + 1).to_pylist(), bool)
            lang, score = np.full(len(ok), UNKNOWN, object), np.zeros(len(ok))
            if model is not None:
                for a, b, x in features(texts):
                    lang[a:b], score[a:b] = model.predict(x)
                    if reject:
                        ok[a:b] &= model.recognised(x, lang[a:b])
            lang[~ok], score[~ok] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.withColumn("__letters", letters).mapInArrow(judge, f"{kept}, lang_pred string, score double")
