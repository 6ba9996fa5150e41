"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Texts become word hashes (letters and digits only, lower case).  Every
   ``SEED``-word n-gram of a test item is a seed; a Bloom filter of fixed size
   holds them, so one pass over the documents finds all places where a seed
   may stand, whatever the number of items.
2. Rare seeds make candidates.  A document that shares just one seed with an
   item is none if the seed is common: held, without another seed of the item,
   by over ``COMMON`` of all documents.  Copies hold other seeds too, so whether
   one is found does not depend on how many copies the corpus holds.
3. Seed hits join documents to items.  Words of a document with hits travel
   as packed hashes, items by their number; no text is shuffled.  A pair is
   left before alignment if too few of the item's words stand near its hits
   for any alignment to reach the score.
4. Each (document, item) pair is aligned word by word (match +2, mismatch or
   gap -1), whole item against the stretches of the document around the hits.
   The score is the best local alignment over that of an exact copy.

Defined results: texts are read whole, however long; items with fewer words
than a seed have none and match nothing; null ids are returned as such, and
items that repeat an id are each compared; null and empty texts match nothing; a repeated document row is its
own row; no item or no document gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.sketch import bloom, contains
from quire.llm.words import batches, ngrams
from quire.session import cut_lineage

#: words in a seed
SEED = 4
#: share of all documents beyond which a seed that they hold alone is common
COMMON = 0.01
#: least share of an exact copy's score
LEAST = 0.5
MATCH, GAP = 2, -1


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, item_words, seeds)``: packed word hashes and the seeds of each item."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words, seeds = [], []
            for _, _, w in batches(part.column(1), plain=True):
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    words.append(w.hashes[a:b].tobytes())
                    seeds.append(np.unique(ngrams(w.hashes[a:b], SEED)).view(np.int64))
            ends = np.cumsum([0, *map(len, seeds)]).astype(np.int32)
            seed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *seeds])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary()), seed], ["item_id", "item_words", "seeds"])

    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(read, "item_id long, item_words binary, seeds array<long>")


def seed_hits(docs: DataFrame, bits: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, doc_words, seeds, places)`` of the rows in which seeds of the filter occur."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b, w in batches(part.column(1), plain=True):
                grams = ngrams(w.hashes, SEED)
                at = np.flatnonzero(contains(shared.value, grams))
                row = np.searchsorted(w.first, at, side="right") - 1
                inside = at + SEED <= w.first[row + 1]
                at, row = at[inside], row[inside]
                rows = np.unique(row)
                cuts = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
                listed = lambda v, t: pa.ListArray.from_arrays(pa.array(cuts), pa.array(v, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(a, b - a).take(pa.array(rows)),
                        pa.array([w.hashes[w.first[r] : w.first[r + 1]].tobytes() for r in rows], pa.binary()),
                        listed(grams[at].view(np.int64), pa.int64()),
                        listed((at - w.first[row]).astype(np.int32), pa.int32()),
                    ],
                    ["doc_id", "doc_words", "seeds", "places"],
                )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(find, "doc_id long, doc_words binary, seeds array<long>, places array<int>")


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words with linear gaps: best score, and the aligned stretch of ``doc``.

    Rows run over the item and are vectorised over the document; a running
    maximum carries gaps along a row.  Of equal scores the earliest end counts.
    """
    n = len(doc)
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, begin, end = 0, 0, 0
    slope = -GAP * np.arange(n + 1)
    for word in item:
        diagonal = score[:-1] + np.where(doc == word, MATCH, -1)
        up = score[1:] + GAP
        new = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        start = np.concatenate([[0], np.where(diagonal >= up, origin[:-1], origin[1:])])
        start = np.where(new == 0, np.arange(n + 1), start)
        lifted = new + slope
        peak = np.maximum.accumulate(lifted)
        left = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        score, origin = peak - slope, start[left]
        at = int(score.argmax())
        if score[at] > best:
            best, begin, end = int(score[at]), int(origin[at]), at
    return best, begin, end


def stretches(places: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Union of ``[place - reach, place + reach]`` as ranges of words."""
    out: list[tuple[int, int]] = []
    for p in np.sort(places).tolist():
        a, b = max(0, p - reach), min(n, p + reach + SEED)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def rare_pairs(pairs: DataFrame, items: DataFrame, documents: int) -> DataFrame:
    """``pairs(row, item, seed, last, places)`` but for those that share just one seed, and that a common one.

    A seed of an item is common if over ``COMMON`` of all documents hold it and no other seed of the item;
    copies hold others too, so they make no seed common.  Items whose seeds are all common keep them.
    """
    alone = pairs.where("seed = last").groupBy("item", "seed").agg(F.count("*").alias("holders")).where(F.col("holders") > COMMON * documents)
    spared = alone.groupBy("item").agg(F.count("*").alias("common")).join(items, "item").where("common < n").select("item")
    return pairs.join(alone.join(spared, "item", "left_semi").select("item", "seed", F.col("seed").alias("last")), ["item", "seed", "last"], "left_anti")


def contaminated(
    docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word)`` of pairs that align to at least ``least``."""
    listed = cut_lineage(item_words(items, item_id, item_text).withColumn("item", F.monotonically_increasing_id()))
    seeds = listed.select("item", F.explode("seeds").alias("seed"))
    found = cut_lineage(seed_hits(docs, bloom(seeds, "seed"), id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    spread = found.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("row", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    # what the filter lets through by chance goes here
    hits = spread.join(seeds, "seed").groupBy("row", "item").agg(F.min("seed").alias("seed"), F.max("seed").alias("last"), F.sort_array(F.collect_set("place")).alias("places"))
    pairs = rare_pairs(cut_lineage(hits), listed.select("item", F.size("seeds").alias("n")), docs.count())
    ready = pairs.join(found.select("row", "doc_id", "doc_words"), "row").join(listed.select("item", "item_id", "item_words"), "item").select("doc_id", "item_id", "places", "doc_words", "item_words")

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc_id, item_id, places, doc_words, item_words in zip(*(c.to_pylist() for c in part.columns)):
                item, doc = np.frombuffer(item_words, np.uint64), np.frombuffer(doc_words, np.uint64)
                top = (0, 0, 0)
                for a, b in stretches(np.asarray(places), 2 * len(item), len(doc)):
                    if np.isin(item, doc[a:b]).mean() < least:  # a word that stands nowhere here cannot match
                        continue
                    s, i, j = align(item, doc[a:b])
                    if s > top[0]:
                        top = (s, a + i, a + j)
                share = top[0] / (MATCH * len(item))
                if share >= least:
                    out.append((doc_id, item_id, share, top[1], top[2]))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])
    return ready.mapInArrow(score, "doc_id long, item_id long, score double, first_word int, last_word int")
