"""N-gram Jaccard join by a token-group matrix.

A document's tokens are its distinct n-word shingles (64-bit hashes).

1. Equal sets collapse to one class before anything is joined, so thousands of
   exact copies are one row (``groupBy`` on a 128-bit digest, partial minima).
2. Tokens have one global order: by how often their hash slot occurs in the
   whole corpus (a table of ``SLOTS`` counts, kept as one byte each: a fixed
   size for the broadcast), rare first, then by hash.  Any order that is the same for all
   sets keeps the join exact, so noise in the table costs speed only.
3. Classes are partitioned into groups of similar sets: those that agree on
   the smallest token under two hash functions (sets of similarity t do with
   probability about t squared).
4. The token-group matrix holds each group's union of tokens, restricted to
   the leading tokens of its members: sets that reach the threshold share at
   least ``LEVEL`` of their leading ``n - ceil(t * n) + LEVEL`` tokens.
   Joining a query's leading tokens with the matrix bounds its overlap with
   every group at once; only groups that reach ``LEVEL`` and hold a fitting
   set size are opened.  Of two groups, the one with fewer members asks.
5. Opened groups meet their queries in blocks of about ``BLOCK`` sets each,
   with whole sets and exact integer arithmetic.  A task returns a spanning
   forest of its links and each set's exact number of links in it, never all pairs.
6. Components of the forest (:mod:`quire.llm.graph`) give the classes' ids.

Defined results: null or word-less texts have 0 shingles and link with
nothing; a null id is kept with a null component and takes no part in links;
repeated rows are each returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import graph
from quire.llm.sketch import bloom, contains
from quire.llm.words import batches, mix, shingle_sets
from quire.session import cut_lineage

#: tokens that two linked sets share among their leading ones
LEVEL = 6
#: sets in a block of a group, and queries in a block
BLOCK = 1500
#: slots of the count table, dealt out in chunks when it is summed
SLOTS = 1 << 22
CHUNKS = 64


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(42)).astype(np.int64)


def _squeeze(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _stretch(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """One byte for each slot: sixteen steps for each doubling of its number of tokens in the whole corpus.

    Every task reports its counts, compressed; they are summed by chunk in two
    levels, so that no task adds up more than some hundred reports at once.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(SLOTS, np.uint32), [], 0

        def add(sets: list[np.ndarray]) -> None:
            slots = np.sort(_slot(np.concatenate(sets)))
            first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
            counts[slots[first]] += np.diff(np.append(first, len(slots))).astype(np.uint32)

        for part in parts:
            for _, _, words in batches(part.column(0)):
                for s in shingle_sets(words, n):
                    held.append(s)
                    size += len(s)
                if size > SLOTS // 8:
                    add(held)
                    held, size = [], 0
        if size:
            add(held)
        if counts.any():
            blobs = [_squeeze(x) for x in np.split(counts, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * CHUNKS, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS // CHUNKS, np.uint64)
        for blob in rows["counts"]:
            total += _stretch(blob)
        return pd.DataFrame({"chunk": [rows.chunk.iloc[0]], "part": [rows.part.iloc[0]], "counts": [_squeeze(total)]})

    fields = "chunk int, part int, counts binary"
    sums = docs.select("text").mapInArrow(count, fields).groupBy("chunk", "part").applyInPandas(add, fields).groupBy("chunk").applyInPandas(add, fields)
    table = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint64)
    for r in sums.collect():  # CHUNKS rows of a fixed size
        table[r.chunk] = _stretch(r.counts)
    return np.minimum(16 * np.log2(table.ravel() + 1.0), 255).astype(np.uint8)


def _leading(s: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` tokens of a set in the global order."""
    order = (levels[_slot(s)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    first = np.argpartition(order, k - 1)[:k] if k < len(s) else np.arange(len(s))
    return s[first]


def _leading_size(size: int, percent: int) -> int:
    return min(size, size - -(-percent * size // 100) + LEVEL)


def _digest(s: np.ndarray) -> tuple[bytes, int]:
    """128-bit digest of a set, and its number as a node: equal for equal sets, whatever the ids."""
    other = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    d = np.array([len(s), s.sum(dtype=np.uint64), other.sum(dtype=np.uint64)], np.uint64)
    return d.tobytes(), int(mix(mix(mix(d[:1]) ^ d[1:2]) ^ d[2:])[0].view(np.int64))


def signatures(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``(id, n_shingles, digest, node, key, leading)`` per row of ``docs(id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, digests, nodes, keys, leads = [], [], [], [], []
            for _, _, words in batches(part.column(1)):
                for s in shingle_sets(words, n):
                    sizes.append(len(s))
                    digest, node = _digest(s) if len(s) else (None, None)
                    digests.append(digest)
                    nodes.append(node)
                    # a group's number: the two smallest tokens, folded to 40 bits (keys that meet are one group, as sound)
                    keys.append(int(mix(s[:1] ^ mix(s ^ np.uint64(0x5BD1E995)).min())[0] >> np.uint64(24)) if len(s) else None)
                    leads.append(_leading(s, shared.value, _leading_size(len(s), percent)).view(np.int64))
            ends = np.cumsum([0, *map(len, leads)]).astype(np.int32)
            lead = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *leads])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), lead],
                ["id", "n_shingles", "digest", "node", "key", "leading"],
            )

    return docs.select("id", "text").mapInArrow(sign, "id long, n_shingles long, digest binary, node long, key long, leading array<long>")


def whole_sets(docs: DataFrame, n: int, needed: np.ndarray) -> DataFrame:
    """``(node, tokens)``: whole sorted sets as packed 64-bit integers, once each, of the nodes in a Bloom filter."""
    shared = docs.sparkSession.sparkContext.broadcast(needed)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, _, words in batches(part.column(0)):
                sets = [s for s in shingle_sets(words, n) if len(s)]
                nodes = np.array([_digest(s)[1] for s in sets], np.int64)
                keep = np.flatnonzero(contains(shared.value, nodes.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["node", "tokens"])

    return docs.select("text").mapInArrow(pack, "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with ``100 * intersection >= percent * union``, by an inverted list of the right side."""
    sizes = np.array([len(x) for x in right], np.int64)
    owners = np.repeat(np.arange(len(right)), sizes)
    tokens = np.concatenate([np.zeros(0, np.uint64), *right])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    found_l, found_r = [], []
    for i, x in enumerate(left):
        a, b = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
        spans = b - a
        total = int(spans.sum())
        if not total:
            continue
        steps = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(total)
        both = np.bincount(owners[steps], minlength=len(right))
        hit = np.flatnonzero(100 * both >= percent * (len(x) + sizes - both))
        found_l.append(np.full(len(hit), i))
        found_r.append(hit)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_l]), np.concatenate([none, *found_r])


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node id of each node's component, by repeated minima over the edges (index pairs a, b)."""
    _, low = np.unique(nodes, return_inverse=True)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            return np.unique(nodes)[low]
        low = new


def link_classes(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """``(a, b, links)``: spanning edges between classes ``(node, number, key, n_shingles, leading)``, and links found for ``a``."""
    grouped = classes.select("node", "number", F.col("n_shingles").cast("int").alias("size"), F.col("key").alias("g"), "leading")
    members = grouped.groupBy("g").agg(F.count("*").cast("int").alias("members"))
    # one exchange by token serves the matrix and the queries
    cells = grouped.join(members, "g").select("number", "size", "g", "members", F.explode("leading").alias("token")).repartition("token")
    matrix = cells.groupBy("token", "g").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("holders"), F.first("members").alias("members"))
    query = cells.select("token", F.col("number").alias("q"), "size", F.col("g").alias("own"), F.col("members").alias("peers"))
    # of two groups the one with fewer members asks, so a large group is asked by few and asks none;
    # in its own group, a token counts for a query only if another member holds it
    asks = (F.col("peers") < F.col("members")) | ((F.col("peers") == F.col("members")) & (F.col("own") < F.col("g")))
    inner = (F.col("g") == F.col("own")) & (F.col("holders") > 1)
    # the bound: leading tokens that a query shares with a group's union, over members of fitting size
    bound = (
        query.join(matrix, "token")
        .where((asks | inner) & (100 * F.col("high") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("low")))
        .groupBy("q", "g").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
        .where(F.col("shared") >= F.least(F.lit(LEVEL), F.ceil(F.col("size") * percent / 100)))
        .select("q", "g")
    )
    asking = classes.select("node", F.col("number").alias("q"), F.col("key").alias("own"))
    opened = cut_lineage(bound.join(asking, "q").select("node", "g", (F.col("g") == F.col("own")).alias("own")))
    # members and queries of an opened group meet in blocks of bounded size
    placed = grouped.select("node", "g")
    cut = opened.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).join(members.select("g", F.ceil(F.col("members") / BLOCK).alias("blocks")), "g")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    asked = opened.join(cut, "g").select("node", "g", all_of("blocks").alias("block"), one_of("parts", 1).alias("part"), F.lit(False).alias("member"), "own")
    inside = placed.join(cut, "g").select("node", "g", one_of("blocks", 2).alias("block"), all_of("parts").alias("part"), F.lit(True).alias("member"), F.lit(False).alias("own"))
    roles = asked.unionByName(inside)
    sets = whole_sets(docs, n, bloom(roles.select("node").distinct(), "node"))
    both = roles.join(sets, "node").select("node", "g", "block", "part", "member", "own", "tokens")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        inside = rows.member.to_numpy(bool)
        unpack = lambda t: [np.frombuffer(x, np.uint64) for x in t]
        ids = rows.node.to_numpy(np.int64)
        q, m, own = ids[~inside], ids[inside], rows.own.to_numpy(bool)[~inside]
        i, j = _linked(unpack(rows.tokens[~inside]), unpack(rows.tokens[inside]), percent)
        other = q[i] != m[j]
        i, j = i[other], j[other]
        nodes, back = np.unique(np.concatenate([q, m]), return_inverse=True)
        left, right = back[: len(q)][i], back[len(q) :][j]
        root = _forest(nodes, left, right)
        # both members of a group ask for each other; a pair of two groups is met here only
        links = np.bincount(left, minlength=len(nodes)) + np.bincount(right[~own[i]], minlength=len(nodes))
        linked = np.unique(np.concatenate([left, right]))
        return pd.DataFrame({"a": nodes[linked], "b": root[linked], "links": links[linked]})

    return both.groupBy("g", "block", "part").applyInPandas(verify, "a long, b long, links long")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, n_links, component_id)`` for every row of ``docs``.

    ``n_links`` counts the distinct other texts (classes) linked with the row's own.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(signatures(rows, n, percent, frequency_levels(rows, n)))
    classes = signed.where("id is not null and node is not null").groupBy("digest").agg(
        F.first("node").alias("node"), F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("key").alias("key"), F.first("leading").alias("leading")
    )
    classes = cut_lineage(classes.withColumn("number", F.monotonically_increasing_id()))
    edges = cut_lineage(link_classes(rows.where("id is not null"), classes, n, percent))
    joined = graph.components(edges.select("a", "b")).withColumnRenamed("component", "root")
    links = edges.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    named = (
        classes.select("digest", "node", "id").join(joined, "node", "left").join(links, "node", "left")
        .select("digest", "id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    named = named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("digest", "n_links", "component_id")
    known = F.col("id").isNotNull()
    return signed.select("id", "n_shingles", "digest").join(named, "digest", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(known, F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"),
        F.when(known, F.coalesce("component_id", "id")).alias("component_id"),
    )
