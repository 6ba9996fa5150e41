"""Exact ranked lexical search: best-first document intervals over range-maximum tables.

1. One pass over the documents keeps, for each, its number of terms and the
   counts of those terms that a query may use (a Bloom filter of fixed size
   holds the queries' terms).  Their sums give the corpus statistics and each
   query term's document frequency and weight.
2. Queries are taken in blocks of at most about ``BLOCK_TERMS`` terms, which
   bounds what is broadcast; each block is one job over the stored counts.
3. A task reads its documents in shards of about ``SHARD`` postings.  A shard's
   posting lists hold a document's impact (its share of the score); over each
   list stands a sparse table that answers range-maximum queries in two reads.
   Equal impacts are ordered by a hash of the document, so that splits stay
   balanced among copies.
4. A query starts from the interval of all documents.  The sum of its terms'
   range maxima bounds every score in an interval.  The intervals of highest
   bound are taken first: one with few postings is scored whole; any other is
   split at the document of the largest single impact, which is scored.  An
   interval that cannot beat the k-th score found so far is dropped unopened.
5. Each task returns its k best of every query; a window keeps the best of all.

All scores are 64-bit integers.  Terms are told apart by 64-bit hashes; two of
a billion terms share one with probability 0.03.

Defined results: null texts hold no term; such documents, and those without a
term, are never found; texts are read whole, however long; every row is a
document, also if rows repeat an id; a null id is returned as null, behind equal
scores; every row of the queries is one, also if ids repeat or are null, and has
ranks of its own; queries without a term in the corpus, an empty table or no
query give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.sketch import bloom, contains
from quire.llm.words import _LOWER, _PUNCT, buffers, mix, pieces, run_hashes
from quire.session import cut_lineage

#: most postings of a shard, and most terms (with repeats) of a block of queries, but for one document or query
SHARD = 1 << 20
BLOCK_TERMS = 1 << 17
#: postings of an interval that is scored whole, and intervals opened at a time
LEAF = 1 << 13
OPENED = 16


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of some texts, and the first one of each text (one place more at the end)."""
    inside = ~_PUNCT[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    finish[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return run_hashes(_LOWER[data], starts, np.flatnonzero(finish) + 1), np.searchsorted(starts, offsets)


def counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the distinct terms of each text, by text."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]))
    return row[head], hashes[head], np.diff(np.append(head, len(row)))


def term_rows(items: DataFrame, text_col: str) -> DataFrame:
    """``(number, term, count)``: distinct terms of each row of ``items`` (its column ``number`` and a text)."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = buffers(part.column(1))
            for a, b in pieces(offsets):
                row, term, count = counted(*terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                number = part.column(0).slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([number, pa.array(term.view(np.int64)), pa.array(count)], ["number", "term", "count"])

    return items.select("number", F.col(text_col).cast("string")).mapInArrow(read, "number long, term long, count long")


def postings(docs: DataFrame, bits: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms, counts)`` of every row: all its terms counted, those in the filter packed."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = buffers(part.column(1))
            for a, b in pieces(offsets):
                hashes, first = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                known = contains(shared.value, hashes)
                row, term, count = counted(hashes[known], np.concatenate([[0], np.cumsum(known)])[first])
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                packed = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(a, b - a), pa.array(np.diff(first)), packed(term), packed(count.astype(np.int32))], ["doc_id", "n", "terms", "counts"]
                )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(read, "doc_id long, n long, terms binary, counts binary")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed values of all rows, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def frequencies(stored: DataFrame) -> DataFrame:
    """``(term, df)``: documents that hold each term."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            term, n = np.unique(_flat(part.column(0), np.int64)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "df"])

    return stored.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """Posting lists of some documents with their range-maximum tables.

    ``ids`` ascend.  ``doc``, ``term`` and ``impact`` are the postings, in any order.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        keep = impact > 0
        doc, term, impact = doc[keep], term[keep], impact[keep]
        order = np.lexsort((doc, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.place = term[order] * len(ids) + self.doc  # ascends: lists by term, documents in each
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        # a posting's rank in its list by impact; ranks are unique, so a maximum names its posting
        self.by_rank = np.lexsort((mix(self.doc.astype(np.uint64)), self.impact, term[order]))
        rank = np.empty(len(doc), np.int32)
        rank[self.by_rank] = np.arange(len(doc), dtype=np.int32)
        longest = int(np.diff(self.first).max(initial=0))
        self.table = np.zeros((max(longest, 1).bit_length(), len(doc)), np.int32)
        self.table[0] = rank
        for j in range(1, len(self.table)):
            half, n = 1 << (j - 1), len(doc) - (1 << j) + 1
            np.maximum(self.table[j - 1, :n], self.table[j - 1, half : half + n], out=self.table[j, :n])
        self.sums = np.zeros(len(ids), np.int64)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of largest impact in each range [a, b) of one list; -1 for empty ranges."""
        size = b - a
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        left = np.where(some, a, 0)
        right = np.where(some, b - (1 << level), 0)
        return np.where(some, self.by_rank[np.maximum(self.table[level, left], self.table[level, right])], -1)

    def search(self, term: np.ndarray, times: np.ndarray, k: int, top: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``top`` (scores and ids, best first, at most ``k``) with this shard's documents merged in."""
        some = self.first[term + 1] > self.first[term]
        term, times = term[some], times[some]
        if not len(term):
            return top
        base = term * len(self.ids)

        def bounded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = self.largest(a, b)
            share = np.where(at >= 0, self.impact[at], 0)
            return (times * share).sum(1), at[np.arange(len(at)), share.argmax(1)]

        def merged(score: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score, ids = np.concatenate([top[0], score]), np.concatenate([top[1], self.ids[doc]])
            best = np.lexsort((ids, -score))[:k]
            return score[best], ids[best]

        a, b = self.first[term][None, :], self.first[term + 1][None, :]
        low = np.zeros(1, np.int64)
        bound, peak = bounded(a, b)
        while len(low):
            if len(top[0]) == k:  # a bound equal to the k-th score may hide a smaller id
                keep = (bound > top[0][-1]) | ((bound == top[0][-1]) & (self.ids[np.minimum(low, len(self.ids) - 1)] < top[1][-1]))
            else:
                keep = bound > 0
            a, b, low, bound, peak = a[keep], b[keep], low[keep], bound[keep], peak[keep]
            if not len(low):
                break
            order = np.argsort(-bound, kind="stable")
            now, later = order[:OPENED], order[OPENED:]
            small = (b[now] - a[now]).sum(1) <= LEAF
            leaf, split = now[small], now[~small]
            if len(leaf):
                size = (b[leaf] - a[leaf]).ravel()
                at = np.repeat(a[leaf].ravel() - np.cumsum(size) + size, size) + np.arange(size.sum())
                doc = self.doc[at]
                np.add.at(self.sums, doc, self.impact[at] * np.repeat(np.tile(times, len(leaf)), size))
                least = top[0][-1] if len(top[0]) == k else 1
                found = np.unique(doc[self.sums[doc] >= least])
                score = self.sums[found]
                self.sums[doc] = 0
                top = merged(score, found)
            pivot = self.doc[peak[split]]
            at = np.clip(np.searchsorted(self.place, base[None, :] + pivot[:, None]), a[split], b[split])
            held = at < b[split]
            held &= self.doc[np.where(held, at, 0)] == pivot[:, None]
            if len(split):
                top = merged((np.where(held, self.impact[np.where(held, at, 0)], 0) * times).sum(1), pivot)
            new_a, new_b = np.concatenate([a[split], at + held]), np.concatenate([at, b[split]])
            new_bound, new_peak = bounded(new_a, new_b)
            a, b = np.concatenate([a[later], new_a]), np.concatenate([b[later], new_b])
            low = np.concatenate([low[later], low[split], pivot + 1])
            bound, peak = np.concatenate([bound[later], new_bound]), np.concatenate([peak[later], new_peak])
        return top


def _search_block(stored: DataFrame, block: list[tuple[int, np.ndarray, np.ndarray]], weights: tuple[np.ndarray, np.ndarray], documents: int, length: int, k: int, shard: int) -> DataFrame:
    """``(number, doc_id, score)``: each task's k best of every query of the block."""
    shared = stored.sparkSession.sparkContext.broadcast((block, *weights))
    none = np.iinfo(np.int64).max

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, weight = shared.value
        queries = [(np.searchsorted(known, term), times) for _, term, times in block]
        tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block]
        held, size = [], 0

        def settle() -> None:
            ids, n, row, term, tf = (np.concatenate([h[c] for h in held]) for c in range(5))
            row += np.repeat(np.cumsum([0, *(len(h[0]) for h in held)])[:-1], [len(h[2]) for h in held])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            m = 75 + 25 * n * documents // length
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
            lists = Shard(ids[order], place[row], term, impact, len(known))
            for q, (term, times) in enumerate(queries):
                tops[q] = lists.search(term, times, k, tops[q])

        for part in parts:
            ids = np.asarray(part.column(0).fill_null(none), np.int64)
            term, each = _flat(part.column(2), np.int64)
            tf = _flat(part.column(3), np.int32)[0].astype(np.int64)
            row = np.repeat(np.arange(len(ids)), each)
            at = np.minimum(np.searchsorted(known, term), len(known) - 1)
            hit = known[at] == term
            held.append((ids, np.asarray(part.column(1), np.int64), row[hit], at[hit], tf[hit]))
            size += int(hit.sum())
            if size >= shard:
                settle()
                held, size = [], 0
        if held:
            settle()
        number = np.repeat([q for q, _, _ in block], [len(t[0]) for t in tops])
        score, ids = (np.concatenate([np.zeros(0, np.int64), *(t[c] for t in tops)]) for c in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, mask=ids == none), pa.array(score)], ["number", "doc_id", "score"])

    return stored.mapInArrow(search, "number long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS, shard: int = SHARD
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` best documents of every query."""
    asked = cut_lineage(queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text")).withColumn("number", F.monotonically_increasing_id()))
    wanted = cut_lineage(term_rows(asked, "text"))
    stored = cut_lineage(postings(docs, bloom(wanted, "term"), id_col, text_col))
    total = stored.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(total[0]), int(total[1])
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = wanted.join(frequencies(stored), "term").select("number", F.struct("term", "count", weight.alias("weight")).alias("t"))
    found = None
    block, weights, size = [], {}, 0

    def run() -> None:
        nonlocal found, block, weights, size
        known = np.array(sorted(weights), np.int64)
        part = _search_block(stored, block, (known, np.array([weights[t] for t in known.tolist()], np.int64)), documents, length, k, shard)
        found = part if found is None else found.unionByName(part)
        block, weights, size = [], {}, 0

    for r in cut_lineage(weighted.groupBy("number").agg(F.collect_list("t").alias("terms"))).toLocalIterator():
        block.append((r.number, np.array([t.term for t in r.terms], np.int64), np.array([t["count"] for t in r.terms], np.int64)))
        weights.update((t.term, t.weight) for t in r.terms)
        size += len(r.terms)
        if size >= block_terms:
            run()
    if block:
        run()
    if found is None:
        found = stored.sparkSession.createDataFrame([], "number long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("number", "item"), "number").select(F.col("item").alias(query_id), "rank", F.col("doc_id").alias(id_col), "score")
