"""Inverted-list vector index (TK2, JN6): learned centroids, lists as partitions, probed by pruning.

* **Learn**: spherical k-means.  The first centroids are the vectors of the
  lowest id digests; each round assigns a bounded sample (all vectors while
  they fit it) to the nearest centroid inside Arrow tasks, which return sums per
  list, never rows.  The driver holds ``n_lists`` centroids.
* **Store**: every vector goes to the list of its nearest centroid; lists are
  partition folders, and skewed lists are split over files.  New vectors are
  appended by the stored centroids.
* **Search**: each query meets its ``probes`` nearest lists only.  Folders
  that no query probes are not read.  Queries are dealt to blocks and lists to
  chunks of bounded size, neighbouring lists together; a query travels once to
  each chunk that its block probes, with a bit for each of its lists, and a list
  once to each block that probes it.  Inside, queries meet the vectors of their
  lists by :mod:`quire.operators.knn`.  More probes trade work for recall;
  probing all lists is the exact search.
* **Measure**: :func:`compared` tells what share of all (query, vector) pairs a
  probe count compares, :func:`calibrate` the least probe count of a wanted
  recall on sampled queries.

Vectors that are NULL, of another size, zero or not finite are stored under list
-1 and never found; queries like that get no hits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.vectors import search_score
from quire.operators.ann import recall_at_k
from quire.operators.joins import broadcast_if_small
from quire.operators.knn import BLOCK_BYTES, LEAST_QUERIES, _as_matrix, _output_schema, paired
from quire.session import cut_lineage
from quire.sources.sinks import path_exists

#: most lists (bounds the centroids held by driver and tasks), and sampled vectors a list to learn from
MAX_LISTS = 4_096
SAMPLE_PER_LIST = 256
#: list of vectors without a direction
NO_LIST = -1
#: most queries of a block and vectors of a chunk of lists
QUERY_BLOCK, LIST_CHUNK = 16_384, 131_072


def default_lists(n: int) -> int:
    """About as many lists as vectors in a list."""
    return max(1, min(MAX_LISTS, math.ceil(math.sqrt(n))))


def _nearest(centroids: np.ndarray, probes: int, spark: SparkSession):
    """Column function: the ``probes`` nearest lists of a vector, nearest first; of equal ones the lower number."""
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def lists(vectors: pd.Series) -> pd.Series:
        c = shared.value
        unit, ok = _as_matrix(vectors, c.shape[1])
        out = [None] * len(vectors)
        some = np.flatnonzero(ok)
        for a in range(0, len(some), 4_096):
            at = some[a : a + 4_096]
            order = np.argsort(-(unit[at] @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            for i, row in zip(at.tolist(), order):
                out[i] = row
        return pd.Series(out, dtype=object)

    return lists


def learn_centroids(vectors: DataFrame, n_lists: int, rounds: int = 5, c_id: str = "vec_id", vec: str = "embedding", sample_per_list: int = SAMPLE_PER_LIST) -> np.ndarray:
    """Unit centroids, one row per list; no usable vector gives none."""
    if not 1 <= n_lists <= MAX_LISTS:
        raise ValueError(f"n_lists must be from 1 to {MAX_LISTS}")
    spark = vectors.sparkSession
    norm2 = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = vectors.select(F.col(c_id).alias("id"), F.col(vec).alias("v")).where((norm2 > 0) & (norm2 < float("inf")))
    sizes = usable.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return np.zeros((0, 0))
    usable = usable.where(F.size("v") == sizes["size"])
    share = min(1.0, sample_per_list * n_lists / sizes["n"])
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else usable
    seeds = sample.orderBy(F.md5(F.col("id").cast("string"))).limit(n_lists).select("v").toPandas()
    if not len(seeds):  # the sample missed a very small table
        seeds = usable.limit(1).select("v").toPandas()
    centroids, _ = _as_matrix(seeds["v"])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(parts):
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for part in parts:
                unit, _ = _as_matrix(part["v"], c.shape[1])
                for a in range(0, len(unit), 4_096):
                    near = (unit[a : a + 4_096] @ c.T).argmax(axis=1)
                    np.add.at(total, near, unit[a : a + 4_096])
                    n += np.bincount(near, minlength=len(c))
            some = np.flatnonzero(n)
            yield pd.DataFrame({"list": some.astype(np.int32), "s": pd.Series(list(total[some]), dtype=object)})

        spread = sample.select("v").mapInPandas(sums, "list int, s array<double>").select("list", F.posexplode("s").alias("i", "x"))
        means = spread.groupBy("list", "i").agg(F.sum("x").alias("x")).toPandas()  # a row per list and component
        new = centroids.copy()  # a list that took no vector keeps its centroid
        new[means["list"].to_numpy(), means["i"].to_numpy()] = means["x"].to_numpy()
        length = np.linalg.norm(new, axis=1)
        keep = length > 0
        centroids = np.where(keep[:, None], new / np.where(keep, length, 1)[:, None], centroids)
        shared.unpersist()
    return centroids


def _assigned(vectors: DataFrame, centroids: np.ndarray, vec: str) -> DataFrame:
    if not len(centroids):
        return vectors.withColumn("list", F.lit(NO_LIST))
    return vectors.withColumn("list", F.coalesce(F.get(_nearest(centroids, 1, vectors.sparkSession)(vec), F.lit(0)), F.lit(NO_LIST)))


def add_vectors(vectors: DataFrame, path: str, vec: str = "embedding") -> None:
    """Append vectors to a stored index by its centroids."""
    rows = _assigned(vectors, stored_centroids(vectors.sparkSession, path), vec)
    # one task a list, large lists split: no folder gets a file from every task
    rows.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{path}/vectors")


def build_index(vectors: DataFrame, path: str, n_lists: int | None = None, rounds: int = 5, c_id: str = "vec_id", vec: str = "embedding", sample_per_list: int = SAMPLE_PER_LIST) -> None:
    """Learn centroids and store every row of ``vectors`` under ``path`` (which must not hold an index yet)."""
    spark = vectors.sparkSession
    if path_exists(spark, f"{path}/centroids"):
        raise ValueError(f"{path} already holds an index; add_vectors appends to it")
    centroids = learn_centroids(vectors, n_lists or default_lists(vectors.count()), rounds, c_id, vec, sample_per_list)
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    add = _assigned(vectors, centroids, vec)
    add.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{path}/vectors")
    # the centroids are written last: an index without them is not there yet
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def stored_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()  # at most MAX_LISTS rows
    return np.stack(rows["centroid"].to_numpy()) if len(rows) else np.zeros((0, 0))


def _probed(queries: DataFrame, centroids: np.ndarray, probes: int, vec: str) -> DataFrame:
    """One row per query and probed list."""
    return queries.withColumn("list", F.explode(_nearest(centroids, probes, queries.sparkSession)(vec)))


def _near_bits(centroids: np.ndarray, probes: int, spark: SparkSession):
    """Column function: ``first`` (nearest list) and ``bits`` (one bit a list, set for the ``probes`` nearest) of a vector."""
    lists = _nearest(centroids, probes, spark).func
    n = len(centroids)

    @F.pandas_udf("first int, bits binary")
    def near(vectors: pd.Series) -> pd.DataFrame:
        mask = np.zeros(n, bool)
        first, bits = [], []
        for row in lists(vectors):
            if row is not None:
                mask[:] = False
                mask[row] = True
            first.append(None if row is None else int(row[0]))
            bits.append(None if row is None else np.packbits(mask).tobytes())
        return pd.DataFrame({"first": pd.Series(first, dtype="Int32"), "bits": bits})

    return near


def _chain(centroids: np.ndarray) -> list[int]:
    """The lists in an order in which neighbours are near."""
    left = np.ones(len(centroids), bool)
    at, order = 0, []
    for _ in range(len(centroids)):
        order.append(at)
        left[at] = False
        if left.any():
            at = int(np.where(left, centroids @ centroids[at], -np.inf).argmax())
    return order


def _dealt(sizes: dict[int, int], order: list[int], most: int) -> list[tuple[int, int, int]]:
    """``(list, first, parts)``: the lists' rows packed in order into places of about ``most`` rows; larger lists have several."""
    place, held, out = 0, 0, []
    for number in order:
        n = sizes.get(number, 0)
        if held and held + n > most:
            place, held = place + 1, 0
        parts = max(1, math.ceil(n / most))
        out.append((number, place, parts))
        place, held = (place + parts, 0) if parts > 1 else (place, held + n)
    return out


def ivf_topk(queries: DataFrame, path: str, k: int, probes: int, *, c_id: str = "vec_id", vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, <stored columns but the vector>, cosine, search_score`` from the ``probes`` nearest lists of each query.

    ``queries`` has unique ``query_id`` and the vector.
    """
    spark = queries.sparkSession
    centroids = stored_centroids(spark, path)
    index = spark.read.parquet(f"{path}/vectors")
    q = queries.select("query_id", F.col(vec).alias("_qvec"))
    schema = _output_schema(index.drop("list"), vec, q.schema["query_id"].dataType)
    if len(centroids):
        near = _near_bits(centroids, probes, spark)
        asked = q.withColumn("_n", near("_qvec")).select("query_id", "_qvec", F.col("_n.first").alias("list"), F.col("_n.bits").alias("_near"))
        found = _searched(cut_lineage(asked.where("list IS NOT NULL")), index.where(F.col("list") != NO_LIST), centroids, schema, k, c_id, vec, exclude_self)
    else:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc(c_id))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("search_score", search_score("cosine"))


def _searched(asked: DataFrame, index: DataFrame, centroids: np.ndarray, schema, k: int, c_id: str, vec: str, exclude_self: bool) -> DataFrame:
    """The best hits of each query and chunk of lists."""
    spark = asked.sparkSession
    n_lists = len(centroids)
    count = lambda df: {r["list"]: r["n"] for r in df.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731 - at most MAX_LISTS rows
    n_asked, n_stored, order = count(asked), count(index), _chain(centroids)
    fit = max(1, BLOCK_BYTES // (8 * max(1, centroids.shape[1])))
    chunk_of = _dealt(n_stored, order, min(LIST_CHUNK, fit))
    chunks = max(first + parts for _, first, parts in chunk_of)
    # smaller blocks only for the cores' sake
    share = max(LEAST_QUERIES, math.ceil(sum(n_asked.values()) * chunks / (4 * spark.sparkContext.defaultParallelism)))
    block_of = _dealt(n_asked, order, min(QUERY_BLOCK, fit, share))
    place = lambda name, key, salt: (F.col("_first") + F.pmod(F.xxhash64(key, F.lit(salt)), F.col("_parts"))).cast("int").alias(name)
    blocks = F.broadcast(spark.createDataFrame(block_of, "list int, _first int, _parts int"))
    chunked = F.broadcast(spark.createDataFrame(chunk_of, "list int, _first int, _parts int"))
    placed = asked.join(blocks, "list").select("query_id", "_qvec", "_near", place("_qb", "query_id", 3))

    def probed(parts):
        for part in parts:
            for block, some in part.groupby("_qb")["_near"]:
                bits = np.bitwise_or.reduce(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=0)
                lists = np.flatnonzero(np.unpackbits(bits)[:n_lists]).astype(np.int32)
                yield pd.DataFrame({"_qb": np.full(len(lists), block, np.int32), "list": lists})

    wanted = cut_lineage(placed.select("_qb", "_near").mapInPandas(probed, "_qb int, list int").distinct())
    lists = sorted(r["list"] for r in wanted.select("list").distinct().collect())  # at most MAX_LISTS numbers
    if len(lists) < n_lists:
        index = index.where(F.col("list").isin(lists))  # folders of other lists are not opened
    stored = index.join(chunked, "list").select(*index.columns, place("_cb", c_id, 5))
    cb = stored.join(broadcast_if_small(wanted, 100_000), "list")
    spread = wanted.join(chunked, "list").select("_qb", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)).alias("_cb")).distinct()
    qb = placed.join(broadcast_if_small(spread, 100_000), "_qb")
    return paired(qb, cb, schema, k, c_id, vec, ["_qb", "_cb"], exclude_self)


def compared(queries: DataFrame, path: str, probes: int, vec: str = "embedding") -> DataFrame:
    """One row: lists, probes, and the share of all (query, vector) pairs that the search compares."""
    spark = queries.sparkSession
    centroids = stored_centroids(spark, path)
    sizes = spark.read.parquet(f"{path}/vectors").where(F.col("list") != NO_LIST).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = _probed(queries.select("query_id", vec), centroids, probes, vec).groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    pairs = sizes.join(asked, "list", "left").agg(F.sum(F.col("n") * F.coalesce("asked", F.lit(0))).alias("met"), F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    return pairs.select(F.lit(len(centroids)).alias("lists"), F.lit(probes).alias("probes"), (F.col("met") / (F.col("n") * F.col("asked") / probes)).alias("share_compared"))


def calibrate(queries: DataFrame, path: str, k: int, target: float, **search) -> int:
    """Least probe count (of doublings, then by halving) whose recall on ``queries`` reaches ``target``.

    ``queries`` should be a small sample: each step searches it once, and once through all lists.
    """
    from quire.session import cut_lineage

    lists = max(1, len(stored_centroids(queries.sparkSession, path)))
    exact = cut_lineage(ivf_topk(queries, path, k, lists, **search).select("query_id", search.get("c_id", "vec_id")))

    def reached(probes: int) -> bool:
        recall = recall_at_k(exact, ivf_topk(queries, path, k, probes, **search), k, search.get("c_id", "vec_id")).first()["recall"]
        return recall is None or recall >= target

    high = 1
    while high < lists and not reached(high):
        high *= 2
    high = min(high, lists)
    low = high // 2 + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(mid) else (mid + 1, high)
    return high
