"""Exact top-k cosine search for a batch of queries (JN6, SC20, WN2, TK1, PR4).

No all-pairs rows are ever produced.  Scores are computed block-wise with
numpy inside Arrow-batched tasks and each task emits only its local top-k per
query; a final per-query window keeps the global top-k (ties: lower id first).

A task never holds the scores of its block: they are made in tiles of
``TILE_QUERIES`` x ``TILE_ROWS`` single-precision products, of which only those
that can still reach a query's k best (by a bound on their rounding) are scored
in double precision.  Of exact copies in a block only the lowest ids are
compared, as no query takes more of them.

Two physical strategies, chosen by a size check on the query side:

* **broadcast** (query batch within ``max_broadcast_rows`` and
  ``max_broadcast_bytes`` of float64 query matrix): the normalised
  query matrix is shipped once to every executor and the corpus is scanned in
  place with ``mapInPandas`` - the corpus is never shuffled.
* **blocked** (larger query sets): queries and corpus are hashed into blocks
  sized from per-group counts, and ``cogroup`` pairs each query block with each
  corpus block.  Every task holds at most about ``query_block`` queries and
  ``corpus_block`` corpus rows (fewer of long vectors: ``BLOCK_BYTES``), however
  large a single group is.

Optional ``group_cols`` restrict matches to rows with equal keys (blocking on a
user key); ``exclude_self`` drops a hit whose id equals the query id.  The
vector's size is part of the key on both paths, so queries of any size meet
corpus vectors of their own size whatever the strategy.  A hit list belongs to
a query id within its group.  Ties are broken by id inside each task, which
returns at most ``k`` rows per query and block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators.joins import broadcast_if_small


#: the vector's size, a key column of every search
SIZE = "_size"
#: scores held at once, and most bytes of a block's vectors in double precision
TILE_QUERIES, TILE_ROWS, BLOCK_BYTES = 1_024, 2_048, 64 << 20
#: fewest queries of a block that is cut only to have work for every core
LEAST_QUERIES = 1_024


def _unit(m: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length; rows that are zero or not finite are marked invalid."""
    norms = np.linalg.norm(m, axis=1)
    ok &= np.isfinite(norms) & (norms > 0)
    m[ok] /= norms[ok, None]
    return m, ok


def _as_matrix(vectors: pd.Series, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stack a Series of arrays into a unit-normalised float64 matrix + validity mask.

    Rows whose size differs from ``dim`` (default: the most common size), NULL
    rows and zero or non-finite norms are marked invalid.
    """
    n = len(vectors)
    if n == 0:
        return np.zeros((0, dim or 0)), np.zeros(0, dtype=bool)
    lens = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    if dim is None:
        valid = lens[lens >= 0]
        dim = int(np.bincount(valid).argmax()) if len(valid) else 0
    ok = lens == dim
    m = np.zeros((n, max(dim, 0)), dtype=np.float64)
    if ok.any():
        m[ok] = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[ok]])
    return _unit(m, ok)


def _arrow_matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_as_matrix` of an Arrow column whose vectors have one size and are not NULL."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole.flatten().to_numpy(zero_copy_only=False)
    m = values.reshape(len(column), -1).astype(np.float64)  # NULL components are NaN
    return _unit(m, np.ones(len(m), bool))


class _Best:
    """The ``k`` best of the vectors met so far, for each query of a block.

    ``x`` holds the unit vectors, ``rank`` their places in the order of ids.  A
    query never takes a vector of its own ``code``; codes of NULL ids are
    negative and differ on the two sides.
    """

    def __init__(self, q: np.ndarray, q_code: np.ndarray | None, x: np.ndarray, code: np.ndarray | None, rank: np.ndarray, k: int):
        self.q, self.q_code, self.x, self.code, self.rank, self.k = q, q_code, x, code, rank, k
        self.q32 = q.astype(np.float32)
        self.floor = np.full(len(q), -np.inf)  # what a query's k-th best reaches at least
        self.margin = 1.2e-7 * (q.shape[1] + 8)  # more than a single-precision product of unit vectors is off
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.new = 0

    def meet(self, rows: np.ndarray, cols: np.ndarray | None = None) -> None:
        """Compare the vectors ``rows`` with the queries ``cols`` (default: all)."""
        cols = np.arange(len(self.q)) if cols is None else cols
        for r0 in range(0, len(rows), TILE_ROWS):
            some = rows[r0 : r0 + TILE_ROWS]
            x32 = self.x[some].astype(np.float32)
            if self.code is not None:
                by_code = np.argsort(self.code[some], kind="stable")
                codes = self.code[some][by_code]
            for c0 in range(0, len(cols), TILE_QUERIES):
                at = cols[c0 : c0 + TILE_QUERIES]
                s = self.q32[at] @ x32.T
                if self.code is not None:
                    low, high = (np.searchsorted(codes, self.q_code[at], side) for side in ("left", "right"))
                    n = high - low
                    if n.any():
                        ends = np.cumsum(n)
                        s[np.repeat(np.arange(len(at)), n), by_code[np.repeat(low - (ends - n), n) + np.arange(ends[-1])]] = -9
                fresh = np.flatnonzero(np.isneginf(self.floor[at]))
                if len(fresh) and len(some) >= self.k:
                    kth = np.partition(s[fresh], len(some) - self.k, axis=1)[:, len(some) - self.k]
                    self.floor[at[fresh]] = np.where(kth > -3, kth - self.margin, -np.inf)
                least = np.maximum(self.floor[at] - self.margin, -3).astype(np.float32) - np.float32(1e-7)
                hits = np.flatnonzero(s >= least[:, None])
                for a in range(0, len(hits), 1 << 16):  # bounded, also when all are alike
                    i, j = np.divmod(hits[a : a + (1 << 16)], len(some))
                    self._take(at[i], some[j])

    def _take(self, cols: np.ndarray, rows: np.ndarray) -> None:
        scores = (self.q[cols] * self.x[rows]).sum(axis=1)  # equal for equal vectors, whatever their place in a block
        fits = scores >= self.floor[cols]
        self.found.append((cols[fits], rows[fits], scores[fits]))
        self.new += int(fits.sum())
        if self.new > max(100_000, 2 * self.k * len(self.q)):
            self._reduce()

    def _reduce(self) -> None:
        cols, rows, scores = (np.concatenate(part) for part in zip(*self.found))
        order = np.lexsort((self.rank[rows], -scores, cols))
        cols, rows, scores = cols[order], rows[order], scores[order]
        starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else np.zeros(0, np.int64)
        place = np.arange(len(cols)) - np.repeat(starts, np.diff(np.r_[starts, len(cols)]))
        last = place == self.k - 1
        self.floor[cols[last]] = scores[last]
        keep = place < self.k
        self.found, self.new = [(cols[keep], rows[keep], scores[keep])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, vectors and cosines."""
        self._reduce()
        return self.found[0]


def _without_copies(x: np.ndarray, rows: np.ndarray, code: np.ndarray | None, rank: np.ndarray, k: int) -> np.ndarray:
    """``rows`` without copies of a vector that no query can take: one takes the lowest ids, at most ``k``."""
    factors = np.random.default_rng(7).integers(1 << 62, size=x.shape[1]) | 1
    digest = np.concatenate([np.zeros(0, np.int64), *[(x[rows[a : a + 8_192]].view(np.int64) * factors).sum(axis=1) for a in range(0, len(rows), 8_192)]])
    order = np.lexsort((rank[rows], digest))
    starts = np.flatnonzero(np.r_[True, np.diff(digest[order]) != 0])
    drop = []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        if b - a > k:
            group = order[a:b]
            copies = group[(x[rows[group]] == x[rows[group[0]]]).all(axis=1)]
            place = np.arange(len(copies))
            if code is None:
                keep = place < k
            else:  # a query's own id is passed over: k + 1 ids, and of a repeated one k rows
                ids = code[rows[copies]]
                first = np.r_[True, ids[1:] != ids[:-1]]
                keep = (np.cumsum(first) <= k + 1) & (place - np.maximum.accumulate(np.where(first, place, 0)) < k)
            drop.append(copies[~keep])
    return np.delete(rows, np.concatenate(drop)) if drop else rows


def _score_block(
    qids: np.ndarray, qmat: np.ndarray, cdf: pd.DataFrame, c_id: str, c_vec: str, k: int, exclude_self: bool
) -> pd.DataFrame | None:
    cmat, cok = _as_matrix(cdf[c_vec], qmat.shape[1])
    if len(qids) == 0 or not cok.any():
        return None
    ids = cdf[c_id].reset_index(drop=True)
    rank = np.empty(len(ids), np.int64)
    rank[ids.sort_values(kind="stable").index.to_numpy()] = np.arange(len(ids))
    code = q_code = None
    if exclude_self:
        code, known = pd.factorize(ids)
        q_code = pd.Index(known).get_indexer(pd.Index(qids))
        q_code = np.where(q_code < 0, -2, q_code)
    best = _Best(qmat, q_code, cmat, code, rank, k)
    best.meet(_without_copies(cmat, np.flatnonzero(cok), code, rank, k))
    cols, rows, scores = best.result()
    out = cdf.drop(columns=[c_vec]).iloc[rows].reset_index(drop=True)
    out["query_id"] = qids[cols]
    out["cosine"] = scores
    return out


def _pair(names: list[str], schema: pa.Schema, c_id: str, c_vec: str, k: int, exclude_self: bool):
    """The k best of a corpus block for each query of a block, as a function of their two tables.

    With a column ``_near`` of the queries (one bit a list) a query meets the rows of its lists (column ``list``) only.
    """

    def solve(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        if not len(queries) or not len(corpus):
            return schema.empty_table()
        q, q_ok = _arrow_matrix(queries["_qvec"])
        x, ok = _arrow_matrix(corpus[c_vec])
        queries, q = queries.filter(pa.array(q_ok)), q[q_ok]
        ids = corpus[c_id].combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        code = q_code = None
        if exclude_self:
            coded = ids.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
            q_ids = queries["query_id"].combine_chunks()
            q_code = pc.index_in(q_ids.cast(ids.type), value_set=coded.dictionary).to_numpy(zero_copy_only=False)
            q_code = np.where(np.isnan(q_code.astype(float)), -2, q_code).astype(np.int64)
        best = _Best(q, q_code, x, code, rank, k)
        rows = np.flatnonzero(ok)
        if "_near" not in queries.column_names:
            best.meet(_without_copies(x, rows, code, rank, k))
        else:
            near = np.frombuffer(b"".join(queries["_near"].to_pylist()), np.uint8).reshape(len(queries), -1)
            lists = corpus["list"].to_numpy()[rows]
            rows, lists = rows[np.argsort(lists, kind="stable")], np.sort(lists)
            starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else []
            for a, b in zip(starts, [*starts[1:], len(lists)]):
                cols = np.flatnonzero(near[:, lists[a] >> 3] >> (7 - (lists[a] & 7)) & 1)
                best.meet(_without_copies(x, rows[a:b], code, rank, k), cols)
        cols, rows, scores = best.result()
        out = corpus.drop_columns([c_vec]).take(pa.array(rows)).append_column("query_id", queries["query_id"].take(pa.array(cols)))
        return out.append_column("cosine", pa.array(scores)).select(names)

    return solve


def _output_schema(corpus: DataFrame, c_vec: str, id_type: T.DataType) -> T.StructType:
    fields = [f for f in corpus.schema.fields if f.name != c_vec]
    return T.StructType(fields + [T.StructField("query_id", id_type), T.StructField("cosine", T.DoubleType())])


def _finish(cands: DataFrame, k: int, c_id: str, group_cols: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id", *group_cols).orderBy(F.desc("cosine"), F.asc(c_id))
    return (
        cands.drop(SIZE).withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("search_score", (F.lit(1.0) + F.col("cosine")) / F.lit(2.0))
    )


def exact_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    *,
    q_id: str = "query_id",
    q_vec: str = "embedding",
    c_id: str = "vec_id",
    c_vec: str = "embedding",
    group_cols: Sequence[str] = (),
    exclude_self: bool = False,
    max_broadcast_rows: int = 4_096,
    max_broadcast_bytes: int = 64 << 20,
    query_block: int = 16_384,
    corpus_block: int = 131_072,
    strategy: str = "auto",
) -> DataFrame:
    """Top-``k`` corpus rows per query (and group) by cosine.

    Returns ``query_id, rank, <corpus columns except the vector>, cosine,
    search_score``.  Queries or corpus rows with a NULL, zero or non-finite
    vector get no hits.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    own_groups = list(group_cols)
    group_cols = [*own_groups, SIZE]
    q = queries.select(F.col(q_id).alias("query_id"), F.col(q_vec).alias("_qvec"), *own_groups).withColumn(SIZE, F.size("_qvec"))
    corpus = corpus.withColumn(SIZE, F.size(c_vec))
    id_type = q.schema["query_id"].dataType
    schema = _output_schema(corpus, c_vec, id_type)

    if strategy in ("auto", "broadcast"):
        # read once (an embedder is called once per query): at most the row bound + 1 reach the
        # driver, and they are broadcast only within the bound in bytes of their float64 matrix
        qpdf = q.limit(max_broadcast_rows + 1).toPandas()
        if len(qpdf) <= max_broadcast_rows and 8 * int(qpdf[SIZE].clip(lower=0).sum()) <= max_broadcast_bytes:
            return _finish(_broadcast_search(corpus, qpdf, schema, k, c_id, c_vec, group_cols, exclude_self), k, c_id, own_groups)
        if strategy == "broadcast":
            raise ValueError("query batch exceeds the broadcast bounds")
    return _finish(
        _blocked_search(q, corpus, schema, k, c_id, c_vec, group_cols, exclude_self, query_block, corpus_block),
        k,
        c_id,
        own_groups,
    )


def _broadcast_search(corpus, qpdf, schema, k, c_id, c_vec, group_cols, exclude_self) -> DataFrame:
    payload = {}
    for g, part in qpdf.groupby(group_cols):  # a NULL key matches nothing
        qmat, qok = _as_matrix(part["_qvec"])
        if qok.any():
            payload[g] = (part["query_id"].to_numpy()[qok], qmat[qok])
    bc = corpus.sparkSession.sparkContext.broadcast(payload)
    q_chunk = 2_048
    row_chunk = 8_192

    def search(batches):
        groups = bc.value
        acc: list[pd.DataFrame] = []
        for pdf in batches:
            for g, cpart in pdf.groupby(group_cols):
                if g not in groups:
                    continue
                qids, qmat = groups[g]
                for r0 in range(0, len(cpart), row_chunk):
                    block = cpart.iloc[r0 : r0 + row_chunk]
                    for q0 in range(0, len(qids), q_chunk):
                        res = _score_block(qids[q0 : q0 + q_chunk], qmat[q0 : q0 + q_chunk], block, c_id, c_vec, k, exclude_self)
                        if res is not None and len(res):
                            acc.append(res)
            if sum(len(a) for a in acc) > 200_000:
                acc = [_reduce(pd.concat(acc, ignore_index=True), k, c_id, group_cols)]
        if acc:
            yield _reduce(pd.concat(acc, ignore_index=True), k, c_id, group_cols)[[f.name for f in schema.fields]]

    return corpus.mapInPandas(search, schema)


def _reduce(df: pd.DataFrame, k: int, c_id: str, group_cols: list[str]) -> pd.DataFrame:
    """Keep each query's top-k (ties broken by id) among accumulated candidates."""
    df = df.sort_values(["query_id", "cosine", c_id], ascending=[True, False, True], kind="mergesort")
    return df.groupby(["query_id", *group_cols], sort=False).head(k).reset_index(drop=True)


def _blocked_search(q, corpus, schema, k, c_id, c_vec, group_cols, exclude_self, query_block, corpus_block):
    gcols = group_cols
    q_stats = q.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_nq"))
    c_stats = corpus.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_nc"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.col(SIZE), F.lit(1))))).cast("long")
    blocks = lambda n, most: F.ceil(F.col(n) / F.least(F.lit(most), fit)).cast("int")
    # queries are cut further only for the cores' sake: a query's hits grow with the corpus blocks
    pairs = 4 * corpus.sparkSession.sparkContext.defaultParallelism
    spread = F.least(F.ceil(F.lit(pairs) / F.col("_bc")), F.ceil(F.col("_nq") / LEAST_QUERIES)).cast("int")
    stats = q_stats.join(c_stats, gcols).withColumn("_bc", blocks("_nc", corpus_block))
    stats = stats.select(*gcols, F.greatest(blocks("_nq", query_block), spread).alias("_bq"), "_bc")
    stats = broadcast_if_small(stats, 100_000)
    qb = (
        q.join(stats, gcols)
        .withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_bq")).cast("int"))
        .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_bc") - 1)))
        .drop("_bq", "_bc")
    )
    cb = (
        corpus.join(stats, gcols)
        .withColumn("_cb", F.pmod(F.xxhash64(c_id), F.col("_bc")).cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_bq") - 1)))
        .drop("_bq", "_bc")
    )
    return paired(qb, cb, schema, k, c_id, c_vec, [*gcols, "_qb", "_cb"], exclude_self)


def paired(qb: DataFrame, cb: DataFrame, schema: T.StructType, k: int, c_id: str, c_vec: str, keys: list[str], exclude_self: bool) -> DataFrame:
    """Each query's ``k`` best of every corpus block that has its block's ``keys``."""
    solve = _pair([f.name for f in schema.fields], to_arrow_schema(schema), c_id, c_vec, k, exclude_self)
    return qb.groupBy(*keys).cogroup(cb.groupBy(*keys)).applyInArrow(solve, schema)
