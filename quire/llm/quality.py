"""Document quality by regularised quadratic discriminant analysis.

Each whole text becomes a few transformed statistics (``FEATURES``): square
roots of shares, logarithms of sizes.  For each class, Spark sums counts,
values and products over the labelled rows; the means and covariances follow
from those sums.  A class covariance is shrunk towards the pooled one
(``pooling``) and that towards a multiple of the identity (``ridge``), so a
statistic that never varies in a class cannot decide alone.  Scores are the
difference of the classes' log densities (half Mahalanobis distances by cached
Cholesky factors, and log determinants) plus the log prior odds, as a
probability.

Statistics are computed once and checkpointed (some 120 bytes a row); only
sums, one small matrix per class, reach the driver, over all labelled rows.

Defined results: null and empty texts have all-zero statistics and a score
like any other; rows are returned as they come (repeated and null ids too);
labels other than 1 count as 0, null labels as none; with rows of one class
only every score is that class, with none 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import batches, ngrams
from quire.session import cut_lineage

FEATURES = (
    "log_words", "log_word_length", "word_length_spread", "capitals", "digits", "symbols", "bars", "exclamations",
    "adjacent_repeats", "distinct_words", "distinct_pairs", "line_breaks", "wide_bytes", "short_words", "full_stops",
)
# byte classes: 0 other, 1 small letter, 2 capital, 3 digit, 4 symbol, 5 bar, 6 exclamation, 7 line break, 8 beyond ASCII, 9 full stop
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 8
_KIND[[ord(c) for c in "#$%&*<>=@[]\\^_`{}~+/"]] = 4
_KIND[[124, 33, 10, 46]] = 5, 6, 7, 9


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of ``FEATURES`` for the texts."""
    out = []
    for a, b, w in batches(texts):
        n = b - a
        size = np.diff(w.offsets)
        row = np.repeat(np.arange(n), size)
        kinds = np.bincount(row * 10 + _KIND[w.data], minlength=n * 10).reshape(n, 10).astype(float)
        wide_capitals = np.zeros(n)
        if len(w.data) > 1:
            at = np.flatnonzero((w.data[:-1] == 0xC3) & (w.data[1:] >= 0x80) & (w.data[1:] <= 0x9E) & (w.data[1:] != 0x97))
            wide_capitals = np.bincount(row[at], minlength=n).astype(float)
        words = np.diff(w.first).astype(float)
        length = (w.ends - w.starts).astype(float)
        owner = np.repeat(np.arange(n), np.diff(w.first))
        total = np.bincount(owner, length, n)
        square = np.bincount(owner, length * length, n)
        short = np.bincount(owner, length <= 3, n)
        pairs = ngrams(w.hashes, 2)
        same = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[1:][same], minlength=n).astype(float)
        single, double = np.zeros(n), np.zeros(n)
        for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            single[i] = len(np.unique(w.hashes[x:y]))
            double[i] = len(np.unique(pairs[x : max(x, y - 1)]))
        some = np.maximum(words, 1)
        bytes_ = np.maximum(size, 1)
        mean = total / some
        letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
        share = lambda v, of: np.sqrt(v / of)
        out.append(np.column_stack([
            np.log1p(words), np.log1p(mean), np.sqrt(np.maximum(square / some - mean * mean, 0)) / (1 + mean),
            share(kinds[:, 2] + wide_capitals, letters), share(kinds[:, 3], bytes_), share(kinds[:, 4], bytes_), share(kinds[:, 5], bytes_), share(kinds[:, 6], bytes_),
            share(repeats, some), single / some, double / np.maximum(words - 1, 1), share(kinds[:, 7], some), share(kinds[:, 8], bytes_), short / some, share(kinds[:, 9], some),
        ]))
    return np.concatenate([np.zeros((0, len(FEATURES))), *out])


def describe(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the statistics of the text."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = statistics(part.column(len(keep)))
            cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))], [*keep, "x"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(read, f"{kept}, x array<double>")


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances and log determinants."""

    def __init__(self, counts: dict[int, float], sums: dict[int, np.ndarray], products: dict[int, np.ndarray], pooling: float, ridge: float):
        self.classes = sorted(counts)
        n = sum(counts.values())
        mean = sum(sums.values()) / n
        within = {k: products[k] - np.outer(sums[k], sums[k]) / counts[k] for k in counts}
        pooled = sum(within.values()) / n
        self.shift, self.scale = mean, np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        size = np.outer(self.scale, self.scale)
        self.means, self.factors, self.logs, self.priors = {}, {}, {}, {}
        for k in counts:
            cov = ((1 - pooling) * within[k] / counts[k] + pooling * pooled) / size
            cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
            self.means[k] = (sums[k] / counts[k] - mean) / self.scale
            self.factors[k] = np.linalg.cholesky(cov)
            self.logs[k] = 2 * np.log(np.diag(self.factors[k])).sum()
            self.priors[k] = np.log(counts[k] / n)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(self.classes) == 1:
            return np.full(len(x), float(self.classes[0]))
        z = (x - self.shift) / self.scale
        log = {}
        for k in self.classes:
            y = np.linalg.solve(self.factors[k], (z - self.means[k]).T)
            log[k] = self.priors[k] - 0.5 * ((y * y).sum(axis=0) + self.logs[k])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def train(labelled: DataFrame, pooling: float = 0.3, ridge: float = 0.05) -> Discriminant | None:
    """Fit on all rows ``(x, label)``."""
    d = len(FEATURES) + 1

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            if len(part):
                x = np.column_stack([np.ones(len(part)), np.stack(part.x)])
                for k in (0, 1):
                    mine = x[(part.label == 1).to_numpy() == bool(k)]
                    total[k] = total.get(k, 0) + mine.T @ mine
        i, j = np.divmod(np.arange(d * d), d)
        for k, m in total.items():
            yield pd.DataFrame({"label": k, "i": i, "j": j, "s": m.ravel()})

    got = labelled.where("label is not null").select("x", "label").mapInPandas(sums, "label int, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s")).collect()
    moments = {k: np.zeros((d, d)) for k in {r.label for r in got}}
    for r in got:
        moments[r.label][r.i, r.j] = r.s
    moments = {k: m for k, m in moments.items() if m[0, 0] > 0}
    if not moments:
        return None
    return Discriminant({k: m[0, 0] for k, m in moments.items()}, {k: m[0, 1:] for k, m in moments.items()}, {k: m[1:, 1:] for k, m in moments.items()}, pooling, ridge)


def score(described: DataFrame, model: Discriminant | None) -> DataFrame:
    """``described`` with ``score`` in place of ``x``."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    names = [c for c in described.columns if c != "x"]

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrow throughout: in pandas a batch of ids with a null becomes floats."""
        for part in parts:
            x = np.asarray(part.column("x").flatten(), float).reshape(-1, len(FEATURES))
            score = shared.value.score(x) if shared.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], [*names, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in described.schema.fields if f.name != "x")
    return described.mapInArrow(judge, f"{kept}, score double")


def quality(docs: DataFrame, labels: DataFrame, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id_col, held_out, score)`` for every row; rows where ``held_out`` is true teach nothing."""
    described = cut_lineage(describe(docs.select(F.col(id_col), F.col(held_out), F.col(text_col)), (id_col, held_out), text_col))
    marks = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    return score(described, train(described.where(f"not {held_out}").join(marks, id_col)))
