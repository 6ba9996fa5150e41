"""SimHash near-duplicates with deletion-variant signatures.

1. A text's fingerprint has a bit set where more than half of its word shingles'
   64-bit hashes have it (XXH64 of the lower-cased, space-joined words, seed 42).
2. Rows of one fingerprint are one class; only classes are compared, so exact
   copies never meet each other.
3. A fingerprint is cut into ``SEGMENTS`` = 3 segments.  Of 4 differing bits at
   least one segment takes at most one.  For every segment the index holds its
   value and, for each of its bits, the value with that bit as a wildcard: 67
   keys a class.  Two classes within 4 bits share the value of a segment or a
   variant whose wildcard is the one bit that differs; each pair is looked at
   under that key only.
4. Keys are dealt by equality and sorted.  A task reads them as a stream, holds
   one key's classes (at most ``BLOCK``) and verifies them by exclusive or.  It
   returns a spanning forest of what it links, never all pairs.  Keys with more
   classes pass through and are dealt again in pairs of blocks.
5. Connected components over the forests give each class its component.

Candidates of a key grow with the classes that share a third of their bits: with
``n`` classes of unrelated texts about ``n / 2**20`` a key, so the work is near
linear up to some ten million classes and grows with their square far beyond.

Defined results: null and empty texts, and texts without a word, have
fingerprint zero and link like any other; texts with fewer words than a shingle
are one shingle of all their words; texts are read whole, however long; repeated
rows and ids each give a row; a null id gives a row with the component of its
fingerprint, null if no linked row has an id; other columns of the table do not
matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.words import _LOWER, _WHITE, buffers, pieces
from quire.session import cut_lineage

SEGMENTS = 3
#: most classes of a key that one task compares with each other
BLOCK = 4096
#: verified pairs held before they are folded into a forest
HELD = 1 << 20
SEED = 42


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every text's shingles, and the first one of each text (one place more at the end)."""
    inside = ~_WHITE[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    finish[tails] = inside[tails]
    sizes = np.flatnonzero(finish) + 1 - starts
    # words one blank apart, in the order of the texts
    low = np.full(len(data) + len(starts) + 1, 32, np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    chars = np.flatnonzero(inside)
    low[chars - np.repeat(starts - at[:-1], sizes)] = _LOWER[data[chars]]
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(len(each)), each)
    a = first[row] + np.arange(bounds[-1]) - bounds[row]
    b = np.minimum(a + n, first[row + 1])
    raw, digest = memoryview(low.tobytes()), xxhash.xxh64_intdigest
    ends = at[b] - 1
    return np.array([digest(raw[i:j], SEED) for i, j in zip(at[a].tolist(), ends.tolist())], np.uint64), bounds


def fold(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: bits set in more than half of its hashes; zero without one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > np.diff(bounds)[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = buffers(part.column(1))
            found = [np.zeros(0, np.uint64)]
            for a, b in pieces(offsets):
                found.append(fold(*shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(found).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(sign, "id long, fp long")


def segments(count: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def signatures(fp: Column) -> Column:
    """All keys of a fingerprint: (segment, wildcard bit + 1 or 0, masked value) in one integer."""
    keys = []
    for s, (low, size) in enumerate(segments()):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1))
        for v in range(size + 1):
            masked = value.bitwiseAND(F.lit(~(1 << (v - 1)))) if v else value
            keys.append(masked.bitwiseOR(F.lit((s * 32 + v) << 22)).cast("int"))
    return F.array(*keys)


def wildcards(keys: np.ndarray) -> np.ndarray:
    """The bit that a pair under each key must differ in; 0 for keys without a wildcard."""
    lows = np.array([low for low, _ in segments()], np.uint64)
    v = (keys >> 22) & 31
    return np.where(v > 0, np.uint64(1) << (lows[keys >> 27] + np.maximum(v - 1, 0).astype(np.uint64)), np.uint64(0))


def _near(a: np.ndarray, b: np.ndarray, wild: np.ndarray, most: int) -> np.ndarray:
    x = a ^ b
    return (np.bitwise_count(x) <= most) & (x != 0) & ((wild == 0) | (x & wild != 0))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links folded to (node, smallest node of its component here), roots left out."""
    if not len(a):
        return a, b
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[i], low[j])
        np.minimum.at(new, low[j], low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    kept = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[kept], nodes[low[kept]]


class Links:
    """Verified pairs of a task, folded whenever many are held."""

    def __init__(self) -> None:
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > HELD:
            a, b = self.take()
            self.a, self.b, self.held = [a], [b], len(a) // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.uint64)]
        a, b = forest(np.concatenate(self.a + none), np.concatenate(self.b + none))
        self.a, self.b, self.held = [], [], 0
        return a, b


def compare_runs(keys: np.ndarray, fps: np.ndarray, most: int, links: Links) -> None:
    """Link all pairs of equal keys; ``keys`` are sorted."""
    wild, at, step = wildcards(keys), np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        hit = at[_near(fps[at], fps[at + step], wild[at], most)]
        links.add(fps[hit], fps[hit + step])
        step += 1


def _linked_in_keys(keyed: DataFrame, most: int, block: int) -> DataFrame:
    """``(a, b, key)``: forests of keys with at most ``block`` classes; rows of other keys come back with their key."""

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
            key = pa.nulls(len(a), pa.int32()) if key is None else pa.array(key, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), key], ["a", "b", "key"])

        links, keys, fps, large = Links(), np.zeros(0, np.int32), np.zeros(0, np.uint64), None

        def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Compare runs that are complete; send on those too large."""
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(first, len(keys)))
            over = np.repeat(sizes > block, sizes)
            if over.any():
                yield out(fps[over], fps[over], keys[over])
            paired = np.repeat((sizes > 1) & (sizes <= block), sizes)
            compare_runs(keys[paired], fps[paired], most, links)
            if links.held > HELD // 4:
                yield out(*links.take())

        for part in parts:
            k, f = np.asarray(part.column(0)), np.asarray(part.column(1)).view(np.uint64)
            if not len(k):
                continue
            if large is not None:  # the rest of a key that is already known to be too large
                n = int(np.searchsorted(k, large, side="right"))
                yield out(f[:n], f[:n], k[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                large = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if last:
                yield from settle(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
            if len(keys) > block:
                large = keys[-1]
                yield out(fps, fps, keys)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from settle(keys, fps)
        yield out(*links.take())

    return keyed.mapInArrow(solve, "a long, b long, key int")


def _linked_in_blocks(large: DataFrame, most: int, block: int) -> DataFrame:
    """``(a, b)``: forests of keys with many classes, met in pairs of blocks of about ``block``."""
    cut = large.groupBy("key").agg(F.ceil(F.count("*") / block).alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    placed = large.join(cut, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "fp")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        fps, left = rows.fp.to_numpy(np.int64).view(np.uint64), rows.left.to_numpy(bool)
        a, b = (fps, fps) if rows.i.iloc[0] == rows.j.iloc[0] else (fps[left], fps[~left])
        wild, links = wildcards(rows.key.to_numpy(np.int32)[:1])[0], Links()
        one, zero = (lambda x: x[x & wild != 0], lambda x: x[x & wild == 0]) if wild else (lambda x: x, lambda x: x)
        for x, y in ((one(a), zero(b)), (zero(a), one(b))) if wild else ((a, b),):
            for k in range(0, len(x), 256):
                i, j = np.nonzero(_near(x[k : k + 256, None], y[None, :], np.uint64(0), most))
                links.add(x[k : k + 256][i], y[j])
        a, b = links.take()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("key", "i", "j").applyInPandas(solve, "a long, b long")


def class_links(classes: DataFrame, most: int = 4, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links between fingerprints (column ``fp``, distinct) that span every component."""
    if not 0 < most < 2 * SEGMENTS:
        raise ValueError(f"most must be from 1 to {2 * SEGMENTS - 1}")
    keyed = classes.select(F.explode(signatures(F.col("fp"))).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = cut_lineage(_linked_in_keys(keyed, most, block))
    blocks = _linked_in_blocks(found.where("key is not null").select("key", F.col("a").alias("fp")), most, block)
    return found.where("key is null").select("a", "b").unionByName(blocks)


def simhash_components(docs: DataFrame, n: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` of every row: 16 hex digits, and the smallest id reachable by links."""
    signed = cut_lineage(fingerprints(docs, n, id_col, text_col))
    classes = cut_lineage(signed.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(class_links(classes.select("fp"), most, block)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return signed.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
