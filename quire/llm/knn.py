"""Exact top-k inner-product search as a Voronoi kNN join.

Vectors become integers, ``floor(scale * x)``, and scores integer inner
products.  Queries and data are grouped by their nearest pivot (Euclidean;
pivots are a bounded sample).  Spark gathers a summary of every group: its
size, radius, largest norm, and for the data the nearest vectors of ``k + 1`` ids.
From the summaries alone:

* a floor for each query group: for a data vector s of group j and a query q
  of group i, ``q.s >= p_i.p_j - r_i |p_j| - n_i |s - p_j|`` (r radius of the
  query group, n its largest norm); the k-th best of these over the listed vectors is a
  score that every query of the group reaches (vectors of one more id are kept,
  as a query never finds rows of its own id);
* a ceiling for each pair of groups: ``q.s <= p_i.p_j + r_i |p_j| + n_i r_j``.

A data group is sent to a block of queries only if its ceiling reaches the
floor of some group in the block.  Blocks hold about ``BLOCK`` queries and
groups are dealt in chunks of about ``CHUNK`` vectors, so a task's rows are
bounded however large a group is; ties and copies are ordered by id inside
the task.  Each task returns k rows per query; a last grouping keeps the best k.

Summaries are at most ``PIVOTS`` rows with k + 1 distances each.  All arithmetic on scores
is exact: components are integers held as doubles; products go through floats or 64-bit
integers where they fit, and pairs of too large vectors through Python's integers.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; a score that a long cannot hold is the nearest long;
only vectors of one length are compared; null ids take no part; rows that repeat an id
are each a candidate and, if the id is asked for, each a query with ranks of its own; a
query row's own id is never its candidate; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: most pivots of one vector length, queries in a block, vectors in a chunk
PIVOTS = 256
BLOCK = 2048
CHUNK = 4096
LONG = (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v, dim)`` of the rows that take part; ``v`` holds integers as doubles."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf"))
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale)
    ok = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, fits))
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"), F.size(vector_col).alias("dim"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _assign(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with ``cell`` (nearest pivot, ties to the first), ``away`` (distance) and ``norm``."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(parts):
        for part in parts:
            cell, away, norm = np.zeros(len(part), np.int32), np.zeros(len(part)), np.zeros(len(part))
            for dim in part.dim.unique():
                at = np.flatnonzero(part.dim == dim)
                for a in range(0, len(at), 8192):
                    some = at[a : a + 8192]
                    x, p = _matrix(part.v.iloc[some]), shared.value[dim]
                    d = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                    cell[some] = d.argmin(1)
                    away[some] = np.linalg.norm(x - p[cell[some]], axis=1)
                    norm[some] = np.linalg.norm(x, axis=1)
            yield part.assign(cell=cell, away=away, norm=norm)

    return rows.mapInPandas(near, "id long, v array<double>, dim int, cell int, away double, norm double")


def plan(
    pivots: np.ndarray, queries: dict[int, tuple[int, float, float]], data: dict[int, tuple[int, float, list[float]]], k: int, ids: dict[int, list[int]] | None = None
) -> tuple[dict[int, list[int]], dict[int, set[int]]]:
    """Query groups' blocks, and the data groups that each block needs.

    ``queries``: cell -> (size, radius, largest norm); ``data``: cell -> (size, radius, nearest distances);
    ``ids``: cell -> ids of the nearest (None: all differ).  Bounds are widened by a millionth against rounding.
    """
    listed = ids or {j: [(j, n) for n in range(len(near))] for j, (_, _, near) in data.items()}
    dots, size = pivots @ pivots.T, np.linalg.norm(pivots, axis=1)
    need: dict[int, set[int]] = {}
    for i, (_, radius, norm) in queries.items():
        reached: dict = {}  # each id by its best bound
        for j, (_, _, near) in data.items():
            for d, x in zip(near, listed[j]):
                reached[x] = max(reached.get(x, -np.inf), dots[i, j] - radius * size[j] - norm * d)
        floors = sorted(reached.values(), reverse=True)
        floor = floors[k] if len(floors) > k else -np.inf  # one id more than k: the query's own may be among them
        slack = 1e-6 * (abs(floor) if np.isfinite(floor) else 0) + 1e-6
        need[i] = {j for j, (_, r, _) in data.items() if (dots[i, j] + radius * size[j] + norm * r) * (1 + 1e-9) + slack >= floor}
    # neighbouring groups share blocks: by nearest pivot to the one before
    blocks: dict[int, list[int]] = {}
    left, block, held = sorted(queries), 0, 0
    at = left[0] if left else 0
    needs: dict[int, set[int]] = {}
    while left:
        at = max(left, key=lambda c: (dots[at, c], -c))
        left.remove(at)
        n = queries[at][0]
        parts = -(-n // BLOCK)  # a large group has blocks of its own
        if parts > 1 or held + n > BLOCK:
            block, held = block + (held > 0), 0
        blocks[at] = list(range(block, block + parts))
        for b in blocks[at]:
            needs.setdefault(b, set()).update(need[at])
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return blocks, needs


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles; those beyond a long are the nearest long."""
    largest = np.abs(q).max(axis=1, initial=0)[:, None] * np.abs(x).max(axis=1, initial=0)[None, :] * q.shape[1]
    if largest.max(initial=0) < 2**53:  # sums of floats are exact
        return (q @ x.T).astype(np.int64)
    wide = largest >= 2**62
    whole = lambda m: np.where(np.abs(m) < 2**62, m, 0).astype(np.int64)
    with np.errstate(over="ignore"):
        s = whole(q) @ whole(x).T
    for i, j in zip(*np.nonzero(wide)):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], x[j]))
        s[i, j] = min(max(exact, -LONG - 1), LONG)
    return s


def _best(q_row: np.ndarray, q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of ``x`` for each query row, ties to the smaller id; exact."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out = []
    for a in range(0, len(q), 256):
        s = _scores(q[a : a + 256], x)
        own = ids[None, :] == q_id[a : a + 256, None]
        for i in range(len(s)):
            row = s[i]
            free = np.flatnonzero(~own[i])
            if len(free) > k:
                least = np.partition(row[free], len(free) - k)[len(free) - k]
                free = np.concatenate([free[row[free] > least], free[row[free] == least][:k]])
            top = free[np.lexsort((ids[free], ~row[free]))][:k]  # ~ turns the order of longs round without overflow
            out.append((np.full(len(top), q_row[a + i]), np.full(len(top), q_id[a + i]), ids[top], row[top]))
    if not out:
        return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.DataFrame({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("row", "query_id", "vec_id", "score"))})


def topk(rows: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: queries are the rows whose id ``every`` divides."""
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    sizes = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():  # a vector length is a table of its own; pivots are a sample of about sqrt(n), at most PIVOTS
        most = int(min(PIVOTS, max(4, np.sqrt(n) / 2)))
        draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < min(1.0, 4 * most / n) * (1 << 30)
        got = vectors.where((F.col("dim") == dim) & draw).select("v").distinct().limit(4 * most).toPandas()
        if not len(got):
            got = vectors.where(F.col("dim") == dim).select("v").limit(1).toPandas()
        x = _matrix(got.v)
        x = x[np.lexsort(x.T)]
        chosen = [0]  # spread out: each next pivot is the sampled vector farthest from those chosen
        far = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(most, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
        pivots[dim] = x[chosen]
    placed = cut_lineage(_assign(vectors, pivots).withColumn("row", F.monotonically_increasing_id()))
    asked = placed.where(F.col("id") % every == 0)
    near = F.slice(F.sort_array(F.collect_list(F.struct("away", "id"))), 1, k + 1)
    # the nearest k + 1 ids of a group come from its parts' nearest, so no group is gathered whole
    part = placed.groupBy("dim", "cell", "id").agg(F.min("away").alias("away")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("dim", "cell", "part").orderBy("away"))).where(F.col("r") <= k + 1)
    nearest = ranked.groupBy("dim", "cell").agg(near.alias("near"))
    data = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).join(nearest, ["dim", "cell"]).collect()
    groups = asked.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.max("norm").alias("m")).collect()
    spark = rows.sparkSession
    to_block, to_cell = [], []
    for dim in sizes:
        blocks, needs = plan(pivots[dim], {g.cell: (g.n, g.r, g.m) for g in groups if g.dim == dim}, {g.cell: (g.n, g.r, [x.away for x in g.near]) for g in data if g.dim == dim}, k, {g.cell: [x.id for x in g.near] for g in data if g.dim == dim})
        chunks = {g.cell: -(-g.n // CHUNK) for g in data if g.dim == dim}
        to_block += [(dim, c, b) for c, b in blocks.items()]
        to_cell += [(dim, j, b, chunks[j]) for b, cells in needs.items() for j in sorted(cells)]
    block_of = spark.createDataFrame(to_block, "dim int, cell int, blocks array<int>")
    wanted = spark.createDataFrame(to_cell, "dim int, cell int, block int, chunks int")
    chunked = placed.join(F.broadcast(wanted), ["dim", "cell"]).select(F.col("dim").alias("d"), F.col("block").alias("b"), F.col("cell").alias("c"), F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("h"), F.col("id").alias("vec"), F.col("v").alias("x"))
    blocked = asked.join(F.broadcast(block_of), ["dim", "cell"]).select("dim", F.element_at("blocks", (F.pmod(F.xxhash64("row", F.lit(5)), F.size("blocks")) + 1).cast("int")).alias("block"), "row", "id", "v")
    cells = wanted.select("dim", "block", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    sent = blocked.join(F.broadcast(cells), ["dim", "block"]).select("dim", "block", "cell", "chunk", "row", "id", "v")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        return _best(left.row.to_numpy(np.int64), left.id.to_numpy(np.int64), _matrix(left.v), right.vec.to_numpy(np.int64), _matrix(right.x), k)

    local = sent.groupBy("dim", "block", "cell", "chunk").cogroup(chunked.groupBy("d", "b", "c", "h")).applyInPandas(solve, "row long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
