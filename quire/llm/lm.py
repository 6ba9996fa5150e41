"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are the words of a text and one end.  Counting is exact over all
training documents; three passes read the texts, none moves them.

1. Word counts: tasks report their distinct words (64-bit hashes), Spark sums.
   N tokens and V distinct words give every word's add-one probability,
   ``(c + 1) / (N + V + 1)``, which is also the trie's lowest order.
2. Trigrams are counted by shards, a shard holding all those whose middle word
   hashes to it; their sums are the counts of the bigrams that begin or end
   with these words.  A middle word of more than half a shard's share of all
   tokens is dealt on over several shards by the word before it; the bigrams
   that begin with it are then summed by that word and given to each of these.
   Tasks send the distinct trigrams of a piece as packed places among its words;
   a word that a Bloom filter of fixed size tells to have fewer than ``LEAST``
   occurrences stands in no stored n-gram and travels as START (as a middle word,
   not at all).  A filter that fills up lets more words through and changes no result.
   Every bigram and trigram of ``LEAST`` occurrences is stored, at any size of
   the corpus: what is gathered grows with it.  Higher orders use absolute
   discounting and back off to lower ones with weights that make each context
   sum to one.
3. Each shard builds a trie in its task: word, bigram and trigram levels;
   pointers and successors are monotone Elias-Fano sequences.  A bigram's
   successor is stored relative to its context's range; a trigram's as the rank
   of its last word among the bigrams of its middle word.  Log probabilities and
   back-off weights are codes of books of ``BOOK`` entries.  No trie passes
   through the driver; each travels as one packed buffer that its scoring task
   maps from an unlinked file.
4. Scoring: a word's own (lowest-order) probability is looked up at once if the
   word is frequent (at least the least power of two of occurrences that at most
   ``2**SHARE`` words have: a proven bound of what is broadcast, not of what is used);
   every other word's hash goes, with its document's place in the batch, to the
   shard that holds the counts of its hashes.  What the two words before change
   in a token's score is found by the shard of the two words before.  Sums per
   document come back and are added; logarithms are additive, so this is exact.

Defined results: null and empty texts are the end token alone; repeated rows
are scored each; null ids (and others of ``held_out`` true) teach nothing;
without training tokens every base probability is 1.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.elias_fano import EliasFano
from quire.llm.sketch import contains, packed_bloom
from quire.llm.words import batches, mix
from quire.session import cut_lineage

#: at most this power of two of frequent words, whose counts every task knows
SHARE = 18
#: least occurrences of a stored bigram or trigram, whatever the corpus
LEAST = 2
START = np.uint64(0x57A127)  # stands before a text, and for words of no stored n-gram
DISCOUNT = 0.75
#: entries in a book of quantised logarithms
BOOK = 1 << 12
END = np.uint64(0x00E4D0F7E87)  # stands for the end token
PIECE = 8 << 20


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, byte planes, compressed."""
    step = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(values.astype(np.uint32).tobytes())


def _unsmall(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).astype(np.int64)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and their counts."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[first], np.diff(np.append(first, len(sorted_keys)))


def _tokens(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end in its place, and each text's first token."""
    n = len(words.first) - 1
    return np.insert(words.hashes, words.first[1:], END), words.first + np.arange(n + 1)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last text, their tokens, each text's first token); word places are not held on to."""
    for a, b, words in batches(texts, size=PIECE):
        tokens = _tokens(words)
        del words
        yield a, b, *tokens


def _released(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what earlier tasks of this worker held in Arrow's pool goes back to the system first."""
    pa.default_memory_pool().release_unused()
    yield from parts


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, c)`` over the training rows of ``docs(text, train)``; the end token has a row like any word."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _released(parts):
            train = np.asarray(part.column(1).to_pylist(), bool)
            for a, b, tokens, first in _pieces(part.column(0)):
                h, c = _runs(np.sort(tokens[np.repeat(train[a:b], np.diff(first))]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select("text", "train").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Lookup:
    """Place of a hash among some sorted ones, by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length()))
        self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        top = (h >> self.shift).astype(np.int64)
        at, end, todo = self.first[top], self.first[top + 1], np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] < end[todo]]
            hit = self.hashes[at[todo]] == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return out


def _planes(values: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers as byte planes, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplanes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _pack3(hashes: np.ndarray, listed: np.ndarray, t: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes]:
    """Triples of places among sorted hashes: the words in use, and places among these column by column.

    Words in use are places in the list of frequent words, then the hashes of those that it lacks (``listed`` is -1).
    """
    ids = np.concatenate([t, u, w])
    if len(ids) * 4 < len(hashes):
        known, at = np.unique(ids, return_inverse=True)
    else:
        used = np.zeros(len(hashes), bool)
        used[ids] = True
        known, at = np.flatnonzero(used), (np.cumsum(used) - 1)[ids]
    mine = listed[known]
    often = mine >= 0
    new = np.where(often, np.cumsum(often), np.cumsum(~often) + np.count_nonzero(often)) - 1
    head = _planes(np.diff(mine[often], prepend=0))
    return len(head).to_bytes(4, "little") + head + _pack(hashes[known[~often]]), _planes(new[at])


def _unpack3(known: bytes, places: bytes, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in use and the places ``t, u, w`` among them."""
    split = 4 + int.from_bytes(known[:4], "little")
    return np.concatenate([frequent[np.cumsum(_unplanes(known[4:split]))], _unpack(known[split:])]), _unplanes(places).reshape(3, -1)


def _order3(t: np.ndarray, u: np.ndarray, w: np.ndarray, size: int, kind: str | None = None) -> np.ndarray:
    """Order by middle, first and last of triples of places below ``size``."""
    if size <= 1 << 21:
        return np.argsort((u.astype(np.int64) << 42) | (t.astype(np.int64) << 21) | w, kind=kind)
    return np.lexsort((w, t, u))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places at which a sorted run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


@dataclass
class Deal:
    """Which shard holds the trigrams of a middle word: words of many tokens are dealt on by the word before."""

    shards: int
    hot: np.ndarray  # sorted hashes
    ways: np.ndarray  # shards of each

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, n: int, shards: int) -> Deal:
        """From the sorted frequent words and their counts; fewer than ``2 * shards`` are hot."""
        ways = np.minimum(-(-counts * 2 * shards // max(n, 1)), shards)
        return cls(shards, hashes[ways > 1], ways[ways > 1])

    def __call__(self, hashes: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Shards of pairs of places among sorted hashes."""
        home = (mix(hashes) % np.uint64(self.shards)).astype(np.int64)
        out = home[u]
        at = np.searchsorted(hashes, self.hot)
        here = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == self.hot)
        ways = np.ones(len(hashes), np.int64)
        ways[at[here]] = self.ways[here]
        split = np.flatnonzero(ways[u] > 1)
        side = (mix(mix(hashes)) >> np.uint64(8)).astype(np.int64)
        out[split] = (out[split] + side[t[split]] % ways[u[split]]) % self.shards
        return out

    def all(self, word: bytes) -> list[int]:
        """Every shard of a hot word, given by the bytes of its hash."""
        word = np.frombuffer(word, np.uint64)
        home = int(mix(word)[0] % np.uint64(self.shards))
        return [(home + k) % self.shards for k in range(int(self.ways[np.searchsorted(self.hot, word)[0]]))]


def _places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, START among them, and the tokens' places there."""
    hashes, ids = np.unique(np.append(tokens, START), return_inverse=True)
    return hashes, ids[:-1].astype(np.int32)


def _triples(hashes: np.ndarray, ids: np.ndarray, first: np.ndarray, several: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(at, t, u, w)``: each token ``at`` that has one before it in its text, sorted by ``u``, ``t`` and ``w``.

    ``u``, ``t`` and ``w`` are the word before, the one before that (or START) and the token, as places among the sorted
    ``hashes``.  Words that the filter ``several`` lacks are START as ``t`` or ``w``; tokens after one are left out.
    """
    start = np.int32(np.searchsorted(hashes, START))
    kept = np.where(contains(several, hashes), np.arange(len(hashes), dtype=np.int32), start)
    begins = np.zeros(len(ids), bool)
    begins[first[:-1]] = True
    ids = kept[ids]
    after = ~begins if use is None else ~begins & use
    after[1:] &= ids[:-1] != start
    at = np.flatnonzero(after)
    u, w = ids[at - 1], ids[at]
    t = np.where(begins[at - 1], start, ids[np.maximum(at - 2, 0)])
    order = _order3(t, u, w, len(hashes))
    return at[order], t[order], u[order], w[order]


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by shard, and where each shard begins."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _gathered(blobs: pd.DataFrame, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(known, t, u, w, c)``: the distinct triples of some blobs, sorted by ``u``, ``t`` and ``w``, and their counts."""
    parts = [_unpack3(k, p, frequent) for k, p in zip(blobs["known"], blobs["places"])]
    known = _distinct(np.concatenate([k for k, _ in parts]))
    ids = np.concatenate([np.searchsorted(known, k).astype(np.int32)[p] for k, p in parts], axis=1)
    c = np.concatenate([_unsmall(x) for x in blobs["counts"]])
    del parts
    order = _order3(*ids, len(known), kind="stable")  # blobs are sorted alike, so this merges runs
    t, u, w = ids[:, order]
    at = _starts(u, t, w)
    return known, t[at], u[at], w[at], np.add.reduceat(c[order], at) if len(at) else c


NGRAMS = "shard int, u binary, hashes array<long>, words binary, two binary, c2 binary, three binary, c3 binary"


def ngram_counts(docs: DataFrame, deal: Deal, frequent: Broadcast, several: Broadcast) -> DataFrame:
    """``NGRAMS``: a row for each shard with its stored bigrams and trigrams, and rows ``u`` of the bigrams of hot words.

    A shard has every n-gram around its middle words: ``(t, u, w)`` for each ``u`` of the shard, ``t`` being ``START``
    at a text's second word.  The counts of ``(u, w)`` and ``(t, u)`` are sums of these; those of ``(u, w)`` for a hot
    ``u`` are sums over its shards, a row ``u`` for each.  ``hashes``: the words whose counts have to be asked for.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Lookup(frequent.value[0])
        for part in _released(parts):
            train = np.asarray(part.column(1).to_pylist(), bool)
            for a, b, tokens, first in _pieces(part.column(0)):
                hashes, ids = _places(tokens)
                listed = place(hashes)
                _, t, u, w = _triples(hashes, ids, first, several.value, np.repeat(train[a:b], np.diff(first)))
                at = _starts(u, t, w)
                c, t, u, w = np.diff(np.append(at, len(t))), t[at], u[at], w[at]
                order, cuts = _by_shard(deal(hashes, t, u), deal.shards)
                c, t, u, w = c[order], t[order], u[order], w[order]
                rows = [(s, *_pack3(hashes, listed, t[x:y], u[x:y], w[x:y]), _small(c[x:y])) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(k, pa.binary()) for k in columns[1:])], ["shard", "known", "places", "counts"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Bigrams and trigrams of at least ``LEAST`` occurrences, as places among the words in use."""
        known, t, u, w, c = _gathered(rows, frequent.value[0])
        size = len(known)
        hot = np.isin(known, deal.hot)
        out = []
        real = known[w] != START
        after, c_after = _summed(u[real].astype(np.int64) * size + w[real], c[real])
        split = hot[after // size]
        for x, y in _spans((after // size)[split]):
            mine = known[after[split][x:y] % size]
            out.append((None, known[after[split][x] // size].tobytes(), [], _pack(mine), None, _small(c_after[split][x:y]), None, None))
        after, c_after = after[~split], c_after[~split]
        real = known[t] != START
        t, u, w, c = t[real], u[real], w[real], c[real]
        at = _starts(u, t)
        before = t[at].astype(np.int64) * size + u[at]
        c_before = np.add.reduceat(c, at) if len(at) else c
        context = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
        two, place = np.unique(np.concatenate([after[c_after >= LEAST], before[c_before >= LEAST]]), return_index=True)
        c2 = np.concatenate([c_after[c_after >= LEAST], c_before[c_before >= LEAST]])[place]
        held = (c >= LEAST) & (known[w] != START)
        context, last, c3 = np.searchsorted(two, before[context[held]]), w[held], c[held]
        mine = _distinct(np.concatenate([two // max(size, 1), two % max(size, 1), last]))
        new = np.zeros(size, np.int64)
        new[mine] = np.arange(len(mine))
        two = new[two // max(size, 1)] * len(mine) + new[two % max(size, 1)]
        three = context * len(mine) + new[last]
        order = np.argsort(three)
        blobs = [_pack(two.view(np.uint64)), _small(c2), _pack(three[order].view(np.uint64)), _small(c3[order])]
        out.append((key[0], None, _unlisted(known[mine], frequent.value[0]), _pack(known[mine]), *blobs))
        return _ngram_rows(out)

    blobs = docs.select("text", "train").mapInArrow(count, "shard int, known binary, places binary, counts binary")
    return blobs.groupBy("shard").applyInPandas(add, NGRAMS)


def hot_bigrams(stored: DataFrame, deal: Deal, frequent: Broadcast) -> DataFrame:
    """The stored bigrams that begin with each hot word, in ``NGRAMS`` rows for each of its shards."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, c = _summed(np.concatenate([_unpack(x) for x in rows["words"]]), np.concatenate([_unsmall(x) for x in rows["c2"]]))
        words, c = words[c >= LEAST], c[c >= LEAST]
        ask = _unlisted(words, frequent.value[0])
        return _ngram_rows([(s, key[0], ask, _pack(words), None, _small(c), None, None) for s in deal.all(bytes(key[0]))])

    return stored.where(F.col("u").isNotNull()).groupBy("u").applyInPandas(add, NGRAMS)


def _ngram_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in NGRAMS.split(", ")])
    return out.assign(shard=out["shard"].astype("Int32"))


def _unlisted(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return words[~np.isin(words, frequent)].view(np.int64)


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    at = _starts(values)
    return list(zip(at.tolist(), np.append(at[1:], len(values)).tolist()))


def _distinct(values: np.ndarray) -> np.ndarray:
    return _runs(np.sort(values))[0]


def _summed(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    distinct, size = _runs(keys[order])
    return distinct, np.add.reduceat(c[order], np.cumsum(size) - size) if len(keys) else np.zeros(0, np.int64)


def tries(stored: DataFrame, hot: DataFrame, counts: DataFrame, frequent: Broadcast, n: int, v: int) -> DataFrame:
    """``(shard, trie, spec)``: the trie of each shard, built in its task with the corpus-wide counts of its words."""
    rows = stored.where(F.col("shard").isNotNull()).unionByName(hot)
    asked = rows.select(F.col("shard").alias("asking"), F.explode("hashes").alias("h")).distinct().join(counts, "h").select("asking", "h", "c")

    def build(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        mine = rows[rows["three"].notna()]
        lists = [(np.frombuffer(r.u, np.uint64)[0], _unpack(r.words), _unsmall(r.c2)) for r in rows[rows["three"].isna()].itertuples(index=False)]
        if len(mine):
            r = mine.iloc[0]
            old, two, c2, three, c3 = _unpack(r.words), _unpack(r.two).view(np.int64), _unsmall(r.c2), _unpack(r.three).view(np.int64), _unsmall(r.c3)
        else:
            old, (two, c2, three, c3) = np.zeros(0, np.uint64), (np.zeros(0, np.int64) for _ in range(4))
        words = _distinct(np.concatenate([old, np.array([u for u, _, _ in lists], np.uint64), *(w for _, w, _ in lists)]))
        if not len(words):
            return pd.DataFrame(columns=["shard", "trie", "spec"])
        size, before, place = len(words), max(len(old), 1), np.searchsorted(words, old)
        own = place[two // before] * size + place[two % before] if len(two) else two
        more = [np.searchsorted(words, u) * size + np.searchsorted(words, w) for u, w, _ in lists]
        pairs, at = np.unique(np.concatenate([own, *more]), return_index=True)
        c2 = np.concatenate([c2, *(c for _, _, c in lists)])[at]
        context = np.searchsorted(pairs, own[three // before]) if len(three) else three
        last = place[three % before] if len(three) else three
        order = np.lexsort((last, context))
        h, c = frequent.value
        c1 = np.zeros(size, np.int64)
        for some, count in ((h, c), (table.h.to_numpy(np.int64).view(np.uint64), table.c.to_numpy(np.int64))):
            here = np.minimum(np.searchsorted(words, some), size - 1)
            hit = words[here] == some
            c1[here[hit]] = count[hit]
        raw, spec = Trie.levels(words, c1, pairs // size, pairs % size, c2, context[order], last[order], c3[order], n, v).buffer()
        return pd.DataFrame([(key[0], raw, json.dumps(spec))], columns=["shard", "trie", "spec"])

    return rows.drop("hashes").groupBy("shard").cogroup(asked.groupBy("asking")).applyInPandas(build, "shard int, trie binary, spec string")


def _book(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``BOOK`` representatives of equal shares of the values, and each value's code."""
    if not len(values):
        return np.zeros(1, np.float64), np.zeros(0, np.uint16)
    rank = np.linspace(0, 1, BOOK + 1)[1:-1] * (len(values) - 1)
    ordered, below = np.sort(values), rank.astype(np.int64)  # one sort: selecting so many ranks takes longer
    low, high = ordered[below], ordered[np.minimum(below + 1, len(values) - 1)]
    edges = np.unique(low + (high - low) * (rank - below))
    code = np.searchsorted(edges, values)
    sums, n = np.bincount(code, values, len(edges) + 1), np.bincount(code, minlength=len(edges) + 1)
    return sums / np.maximum(n, 1), code.astype(np.uint16)


@dataclass
class Trie:
    """Levels of the model; all arrays may lie in a memory map."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    unigram: np.ndarray  # log10 of the add-one probability
    back1: tuple[np.ndarray, np.ndarray]  # book, codes by word
    pointer2: EliasFano  # words + 1
    next2: EliasFano
    prob2: tuple[np.ndarray, np.ndarray]
    back2: tuple[np.ndarray, np.ndarray]
    pointer3: EliasFano  # bigrams + 1
    next3: EliasFano
    prob3: tuple[np.ndarray, np.ndarray]

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, two: tuple[np.ndarray, np.ndarray], three: tuple[np.ndarray, np.ndarray], n: int, v: int, bits: int = 20) -> Trie:
        """From sorted words and sorted packed bigram and trigram keys with their counts."""
        mask = (1 << bits) - 1
        context = np.searchsorted(two[0], three[0] >> bits)
        return cls.levels(words, counts, two[0] >> bits, two[0] & mask, two[1], context, three[0] & mask, three[1], n, v)

    @classmethod
    def levels(cls, words, counts, u, w, c2, context, last, c3, n: int, v: int) -> Trie:
        """From sorted words, sorted bigrams ``(u, w)`` and sorted trigrams ``(context, last)``, contexts being places of bigrams."""
        size, bigrams = len(words), len(u)
        p1 = (counts + 1.0) / (n + v + 1.0)
        p2 = np.maximum(c2 - DISCOUNT, 1e-9) / counts[u] if size else np.zeros(0)
        rest = lambda kept, lower: np.clip(1 - kept, 1e-9, None) / np.clip(1 - lower, 1e-9, None)
        back1 = np.log10(rest(np.bincount(u, p2, size), np.bincount(u, p1[w] if size else None, size))) if size else np.zeros(0)
        middle = w[context]
        lower = np.searchsorted(u * size + w, middle * size + last)
        p3 = np.maximum(c3 - DISCOUNT, 1e-9) / c2[context] if len(context) else np.zeros(0)
        back2 = np.log10(rest(np.bincount(context, p3, bigrams), np.bincount(context, p2[lower] if bigrams else None, bigrams))) if bigrams else np.zeros(0)
        pointer2 = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=size))]).astype(np.int64)
        pointer3 = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=bigrams))]).astype(np.int64)
        return cls(
            words, counts, np.log10(p1), _book(back1), EliasFano.of(pointer2), EliasFano.of(_rising(w, pointer2)), _book(np.log10(p2)), _book(back2),
            EliasFano.of(pointer3), EliasFano.of(_rising(lower - pointer2[middle], pointer3)), _book(np.log10(p3)),
        )

    def arrays(self) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for x in vars(self).values():
            out += x.parts() if isinstance(x, EliasFano) else list(x) if isinstance(x, tuple) else [x]
        return out

    def buffer(self) -> tuple[bytes, list[tuple[str, int, int]]]:
        """All levels in one buffer, and (type, offset, length) of its arrays."""
        out, table = bytearray(), []
        for x in self.arrays():
            out += b"\0" * (-len(out) % 8)
            table.append((x.dtype.str, len(out), len(x)))
            out += x.tobytes()
        return bytes(out) + b"\0" * 8, table

    @classmethod
    def mapped(cls, raw: bytes, table: list[tuple[str, int, int]]) -> Trie:
        """The trie over a read-only memory map of an unlinked file."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        it = iter([np.frombuffer(held, t, n, at) for t, at, n in table])
        take = lambda n: [next(it) for _ in range(n)]
        fields = []
        for kind in ("a", "a", "a", "b", "e", "e", "b", "b", "e", "e", "b"):
            fields.append(next(it) if kind == "a" else tuple(take(2)) if kind == "b" else EliasFano.from_parts(take(4)))
        return cls(*fields)

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log10 probability of each token given the two before it in its text.

        ``ids``: places among ``words``, -1 for others, whose own (lowest-order) probability is left out.
        """
        n = len(ids)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = np.where(ids >= 0, self.unigram[ids], 0.0) if len(self.words) else np.zeros(n)
        before = np.full(n, -1, np.int64)
        before[1:] = np.where(owner[1:] == owner[:-1], ids[:-1], -1)
        known = np.flatnonzero(before >= 0)
        if not len(known):
            return out
        out[known] += self.back1[0][self.back1[1][before[known]]]
        pair = np.full(n, -1, np.int64)  # the bigram that ends at each token
        asked = known[ids[known] >= 0]
        u = before[asked]
        begin, stop = self.pointer2.access(u), self.pointer2.access(u + 1)
        pair[asked] = self._successor(self.next2, ids[asked], begin, stop)
        hit = np.flatnonzero(pair >= 0)
        out[hit] = self.prob2[0][self.prob2[1][pair[hit]]]
        context = np.full(n, -1, np.int64)  # the bigram before each token
        context[1:] = np.where(owner[1:] == owner[:-1], pair[:-1], -1)
        held = np.flatnonzero(context >= 0)
        out[held] += self.back2[0][self.back2[1][context[held]]]
        asked = held[pair[held] >= 0]
        begin, stop = self.pointer3.access(context[asked]), self.pointer3.access(context[asked] + 1)
        rank = pair[asked] - self.pointer2.access(before[asked])
        found = self._successor(self.next3, rank, begin, stop)
        out[asked[found >= 0]] = self.prob3[0][self.prob3[1][found[found >= 0]]]
        return out

    def gain(self, known: np.ndarray, t: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the words ``t`` and ``u`` before it change in the log10 probability of ``w``; equal pairs ``(u, t)`` stand together.

        ``known``: some words' places among ``words``, -1 for others; ``t``, ``u``, ``w``: places in ``known``.
        """
        here = np.flatnonzero(known >= 0)
        begin, stop, back1 = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), np.zeros(len(known))
        begin[here], stop[here] = self.pointer2.access(known[here]), self.pointer2.access(known[here] + 1)
        back1[here] = self.back1[0][self.back1[1][known[here]]]
        base = self._base(self.next2, begin, stop)

        def bigram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            out = np.full(len(first), -1, np.int64)
            some = np.flatnonzero((stop > begin)[first] & (known >= 0)[second])
            a = first[some]
            found = self.next2.find(known[second[some]] + base[a])
            out[some] = np.where((found >= begin[a]) & (found < stop[a]), found, -1)
            return out

        pair = bigram(u, w)
        out = back1[u]
        hit = np.flatnonzero(pair >= 0)
        out[hit] = self.prob2[0][self.prob2[1][pair[hit]]] - self.unigram[known[w[hit]]]
        at = _starts(t, u)
        context = bigram(t[at], u[at])
        some = np.flatnonzero(context >= 0)
        change, begin3, stop3 = np.zeros(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        change[some] = self.back2[0][self.back2[1][context[some]]]
        begin3[some], stop3[some] = self.pointer3.access(context[some]), self.pointer3.access(context[some] + 1)
        base3 = self._base(self.next3, begin3, stop3)
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
        out += change[run]
        asked = np.flatnonzero((pair >= 0) & (stop3 > begin3)[run])
        run = run[asked]
        found = self.next3.find(pair[asked] - begin[u[asked]] + base3[run])
        hit = (found >= begin3[run]) & (found < stop3[run])
        asked, found = asked[hit], found[hit]
        out[asked] = self.prob3[0][self.prob3[1][found]] - self.unigram[known[w[asked]]]
        return out

    @staticmethod
    def _base(values: EliasFano, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """What each range's successors are raised by."""
        out = np.zeros(len(begin), np.int64)
        some = np.flatnonzero((stop > begin) & (begin > 0))
        out[some] = values.access(begin[some] - 1) + 1
        return out

    @staticmethod
    def _successor(values: EliasFano, wanted: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Place of each wanted successor within its context's range, or -1.

        A range's successors are raised by one more than the last value before it; what is found
        beyond the range belongs to another context.
        """
        out = np.full(len(wanted), -1, np.int64)
        some = np.flatnonzero(stop > begin)
        if len(some):
            base = np.where(begin[some] > 0, values.access(np.maximum(begin[some] - 1, 0)) + 1, 0)
            found = values.find(wanted[some] + base)
            out[some] = np.where((found >= begin[some]) & (found < stop[some]), found, -1)
        return out


def _rising(values: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Ranges of increasing values as one increasing sequence: each range starts above the last value before it."""
    if not len(values):
        return values
    last = np.where(np.diff(pointer) > 0, values[np.maximum(pointer[1:] - 1, 0)] + 1, 0)
    base = np.concatenate([[0], np.cumsum(last)[:-1]])
    return values + np.repeat(base, np.diff(pointer))


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast, Broadcast, Deal, int, int]:
    """(rarer words' counts, tries by shard, frequent words and their counts, filter, shards of middle words, N, V) from ``docs(text, train)``."""
    spark = docs.sparkSession
    counts = cut_lineage(word_counts(docs))
    sizes = counts.groupBy(F.floor(F.log2("c")).alias("power")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # at most 64 rows
    n, v = sum(r.n for r in sizes), sum(r.v for r in sizes)
    least = next(1 << k for k in range(1, 65) if sum(r.v for r in sizes if r.power >= k) <= 1 << SHARE)
    often = counts.where(F.col("c") >= least).toPandas()  # at most 2**SHARE rows
    h = often.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, c = h[order], often.c.to_numpy(np.int64)[order]
    frequent = spark.sparkContext.broadcast((h, c))
    several = spark.sparkContext.broadcast(packed_bloom(counts.where(F.col("c") >= LEAST), "h"))
    deal = Deal.of(h, c, n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = cut_lineage(ngram_counts(docs, deal, frequent, several))
    counts = counts.where(F.col("c") < least)
    return counts, tries(stored, hot_bigrams(stored, deal, frequent), counts, frequent, n, v), frequent, several, deal, n, v


def _per_doc(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def score(docs: DataFrame, counts: DataFrame, model: DataFrame, frequent: Broadcast, several: Broadcast, deal: Deal, n: int, v: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` (a long id and a boolean) with ``n_tokens, n_known, train_tokens, base_score, score`` for ``docs(*keep, text)``."""
    shards = deal.shards
    log_all = float(np.log10(n + v + 1.0))
    fields = "shard int, batch long, ids binary, marks binary, x binary, y binary, z binary"

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, often = Lookup(frequent.value[0]), frequent.value[1]
        task, number = TaskContext.get().partitionId(), 0
        for part in _released(parts):
            for a, b, tokens, first in _pieces(part.column(2)):
                owner = np.repeat(np.arange(b - a), np.diff(first))
                hashes, ids = _places(tokens)
                listed_at = place(hashes)
                known = (listed_at >= 0)[ids]
                base = _per_doc(np.where(listed_at >= 0, np.log10(often[listed_at] + 1.0) if len(often) else 0.0, 0.0)[ids], owner, b - a)
                batch, number = (task << 32) + number, number + 1
                listed = part.column(0).slice(a, b - a)
                absent = np.asarray(listed.is_null().to_pylist(), np.int64)
                flags = np.asarray(part.column(1).slice(a, b - a).to_pylist(), np.int64) | absent << 1 | np.bincount(owner, known, b - a).astype(np.int64) << 2
                rows = [(int(batch % shards), np.asarray(listed.fill_null(0), np.int64).tobytes(), flags.tobytes(), np.diff(first).astype(np.int64).tobytes(), base.tobytes(), None)]
                rare, who = tokens[~known], owner[~known]
                shard = (rare % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((rare, shard))
                rare, who = rare[order], who[order]
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows += [(s, _pack(rare[x:y]), None, _small(who[x:y]), None, None) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                at, t, u, w = _triples(hashes, ids, first, several.value)
                order, cuts = _by_shard(deal(hashes, t, u), shards)
                who, t, u, w = owner[at[order]], t[order], u[order], w[order]
                rows += [(s, p[0], None, _planes(who[x:y]), p[1], None) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x for p in [_pack3(hashes, listed_at, t[x:y], u[x:y], w[x:y])]]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array([batch] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "batch", "ids", "marks", "x", "y", "z"]
                )

    def count(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        held = table[table["spec"].notna()]
        trie = Trie.mapped(held.trie.iloc[0], json.loads(held.spec.iloc[0])) if len(held) else None
        place = Lookup(trie.words) if len(held) else None
        table = table[table["spec"].isna()]
        h = table.h.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], table.c.to_numpy(np.float64)[order]
        out = []
        for r in rows.itertuples(index=False):
            if r.marks is not None:
                out.append((r.batch, r.ids, r.marks, r.x, r.y, r.z))
                continue
            if r.y is not None:  # what the words before change in each word's own score
                if trie is not None:
                    known, ids = _unpack3(r.ids, r.y, frequent.value[0])
                    at = _starts(*ids)
                    more = np.repeat(trie.gain(place(known), *ids[:, at]), np.diff(np.append(at, ids.shape[1])))
                    value = np.bincount(who := _unplanes(r.x), more)
                    docs_ = np.flatnonzero(np.bincount(who))
                    out.append((r.batch, docs_.tobytes(), None, value[docs_].tobytes(), None, None))
                continue
            rare, who = _unpack(r.ids), _unsmall(r.x)
            at = np.minimum(np.searchsorted(h, rare), max(len(h) - 1, 0))
            seen = (h[at] == rare) & (c[at] > 0) if len(h) else np.zeros(len(rare), bool)
            docs_, back = np.unique(who, return_inverse=True)
            value = np.bincount(back, np.log10(np.where(seen, c[at], 0.0) + 1.0) if len(h) else None, len(docs_)) if len(h) else np.zeros(len(docs_))
            out.append((r.batch, docs_.tobytes(), None, value.tobytes(), np.bincount(back, seen, len(docs_)).tobytes(), None))
        return pd.DataFrame(out, columns=["batch", "ids", "marks", "x", "y", "z"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        main = rows[rows["marks"].notna()].iloc[0]
        flags = np.frombuffer(main["marks"], np.int64)
        ids = np.frombuffer(main.ids, np.int64)
        length = np.frombuffer(main.x, np.int64)
        base, more = np.frombuffer(main.y, np.float64).copy(), np.zeros(len(ids))
        known = flags >> 2
        for r in rows[rows["marks"].isna()].itertuples(index=False):
            at = np.frombuffer(r.ids, np.int64)
            if r.y is None:
                more[at] += np.frombuffer(r.x, np.float64)
                continue
            base[at] += np.frombuffer(r.x, np.float64)
            seen = np.frombuffer(r.y, np.float64)
            known = known + np.bincount(at, seen, len(ids)).astype(np.int64)
        return pd.DataFrame({
            keep[0]: pd.array(ids, "Int64").copy() if not (flags & 2).any() else pd.array(np.where(flags & 2, None, ids), "Int64"),
            keep[1]: (flags & 1).astype(bool), "n_tokens": length, "n_known": known, "train_tokens": np.int64(n), "base_score": base - length * log_all, "score": base - length * log_all + more,
        })

    rows = docs.select(F.col(keep[0]).cast("long"), F.col(keep[1]).cast("boolean"), F.col("text").cast("string")).mapInArrow(look, fields)
    rare = counts.withColumn("shard", F.expr(f"cast(pmod(cast(h as decimal(20,0)) + if(h < 0, 18446744073709551616, 0), {shards}) as int)"))
    rare = rare.select("shard", "h", "c", F.lit(None).cast("binary").alias("trie"), F.lit(None).cast("string").alias("spec"))
    held = rare.unionByName(model.select("shard", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("c"), "trie", "spec"))
    summed = rows.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(count, "batch long, ids binary, marks binary, x binary, y binary, z binary")
    return summed.groupBy("batch").applyInPandas(join, f"`{keep[0]}` long, `{keep[1]}` boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``held_out`` is false and score all rows."""
    rows = docs.select(F.col(id_col), F.col(held_out), F.col(text_col).cast("string").alias("text"), (~F.col(held_out)).alias("train"))
    counts, model, frequent, several, deal, n, v = train(rows)
    return score(rows, counts, model, frequent, several, deal, n, v, (id_col, held_out))
