"""Approximate candidates + exact re-rank (TK2), with a recall report.

Vectors are scaled to unit length and rounded to ``LEVELS`` steps a side: one
signed byte per component in place of eight bytes.  Candidate ranking runs over
these codes with the block-wise search of :mod:`quire.operators.knn`; the
``num_candidates`` best of each query are joined back to their full vectors
and re-ranked by the exact cosine, in Arrow batches.  More candidates
trade work for recall; every query gets ``k`` hits when ``k`` vectors fit it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import let
from quire.functions.vectors import norm, search_score
from quire.operators.knn import _arrow_matrix, exact_topk
from quire.session import cut_lineage

LEVELS = 127


def codes(vec: str) -> Column:
    """Signed steps of the unit vector; NULL for vectors without a direction."""
    # the norm is bound once a vector, not computed for each component
    def steps(n: Column) -> Column:
        fits = n.isNotNull() & (n > 0) & ~F.isnan(n) & (n < float("inf"))
        return F.when(fits, F.transform(vec, lambda x: F.floor(x.cast("double") / n * LEVELS + 0.5).cast("byte")))

    return let(norm(vec), steps)


def _with_cosine(pairs: DataFrame) -> DataFrame:
    """``cosine`` of the vectors ``_q`` and ``_c`` (of one size, with a direction) in place of them."""
    names = [c for c in pairs.columns if c not in ("_q", "_c")]
    schema = T.StructType([*[pairs.schema[c] for c in names], T.StructField("cosine", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["_q"].value_lengths().to_numpy()
            scores = np.empty(len(batch))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                q, c = (_arrow_matrix(batch[side].take(pa.array(at)))[0] for side in ("_q", "_c"))
                scores[at] = (q * c).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(scores)], names=schema.names)

    return pairs.mapInArrow(task, schema)


def approx_topk(
    queries: DataFrame, corpus: DataFrame, k: int, *, num_candidates: int = 50, c_id: str = "vec_id", vec: str = "embedding", exclude_self: bool = False
) -> DataFrame:
    """``query_id, rank, <corpus columns but the vector>, cosine, search_score``; ids are unique on each side."""
    if num_candidates < k:
        raise ValueError("num_candidates must be at least k")
    # written once: the search reads each side several times
    q = cut_lineage(queries.select("query_id", codes(vec).alias("_code")))
    c = cut_lineage(corpus.select(c_id, codes(vec).alias("_code")))
    found = exact_topk(q, c, num_candidates, q_vec="_code", c_id=c_id, c_vec="_code", exclude_self=exclude_self).select("query_id", c_id)
    full = found.join(queries.select("query_id", F.col(vec).alias("_q")), "query_id").join(corpus.withColumnRenamed(vec, "_c"), c_id)
    ranked = _with_cosine(full)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc(c_id))
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("search_score", search_score("cosine"))


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int, c_id: str = "vec_id") -> DataFrame:
    """Share of exact top-k hits the approximate search also returned (one row)."""
    hit = exact.join(approx.select("query_id", c_id).withColumn("_hit", F.lit(1)), ["query_id", c_id], "left")
    return hit.agg(
        F.lit(k).alias("k"),
        F.countDistinct("query_id").alias("n_queries"),
        (F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"),
    )
