"""Best-fit packing of tokenised documents, improved by swap-based local search.

* A document is its token ids and one end id.  Ids come from the tokenizer
  file given; a text is cut into the tokenizer's own pre-token pieces and a
  bounded cache remembers each piece's ids, so only new pieces are tokenized.
* Documents longer than a sequence are cut into full pieces; what is left over
  is their first piece.  Full pieces are sequences of their own.
* The other pieces are dealt evenly, by a hash of their own number, into groups
  of about ``GROUP`` pieces.  A group starts from best-fit decreasing; then
  local search works on its underfull bins: it moves a piece, or exchanges one
  piece for one or two for one, whenever that raises the sum of squared fills,
  which drives small bins towards empty.  A bin that empties is removed.  The
  search ends once no exchange between any two bins raises the sum, or no fewer
  sequences could hold the group's tokens.
* A group can leave a part of a sequence unused however many groups there
  are, so the bound on waste is one sequence for each ``GROUP`` pieces plus
  what local search cannot close.

Only lengths are shuffled (some 60 bytes a piece); they are checkpointed, so
texts are tokenized once.  Defined results: a null or empty text is the end id
alone; repeated rows and ids are packed as often as they occur; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import buffers, pieces, run_hashes
from quire.session import cut_lineage

#: pieces in a group, on average
GROUP = 6000
#: remembered pre-token pieces in a Python worker
CACHE = 200_000
#: bytes of text tokenized at a time
PIECE_BYTES = 2 << 20

# Classes of the byte-level vocabulary's pre-token pieces (fixed values of the tokenizer):
# white space, letters, digits, and all else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_SHORT = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")  # after an apostrophe
_STATE: dict[str, Ids] = {}


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-token pieces of texts of ASCII and two-byte Latin letters."""
    kind = _CLASS[data]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    start = head[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else is a piece or, if a blank, belongs to what follows
    last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~head[1:-1])
    start[last] = True
    start[last + 1] = data[last] != 32
    quote = np.flatnonzero((data[:-1] == 39) & start[:-1] & (kind[1:] == 1) & ~head[1:-1])
    for i in quote.tolist():
        for tail in _SHORT:
            end = i + 1 + len(tail)
            if data[i + 1 : end].tobytes() == tail and not head[i + 2 : end].any():
                start[i + 1] = False
                if end < len(data):
                    start[end] = True
    return np.flatnonzero(start)


class Ids:
    """Token ids of texts by a byte-level vocabulary file.

    Texts of ASCII and Latin letters are cut into pieces by numpy; equal
    pieces have equal ids, which a bounded cache remembers by hash.  Other
    texts go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [t.encode() for t in special]
        # bytes are written as printable characters in the file: those that print stand for themselves
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}
        ranks = {bytes(shown[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t not in special}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        self.words = Encoding("words", pat_str=r" ?\p{L}+|[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    @classmethod
    def at(cls, path: str) -> Ids:
        """One for each worker process and file."""
        if path not in _STATE:
            _STATE[path] = cls(path)
        return _STATE[path]

    def _forget(self) -> None:
        self.place: dict[int, int] = {}  # hash of a piece -> its place in the tables
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        """Ids of new pieces; words after a blank are tokenized together and cut apart by their lengths in bytes."""
        words = [p[:1] == b" " and p[1:].decode().isalpha() for p in pieces]
        order = [k for k, w in enumerate(words) if w] + [k for k, w in enumerate(words) if not w]
        joined = b"".join(pieces[k] for k in order[: sum(words)])
        ids = np.array(self.words.encode_ordinary(joined.decode()), np.int64)
        ends = np.cumsum(self.width[ids])
        sizes = np.cumsum([len(pieces[k]) for k in order[: sum(words)]], dtype=np.int64)
        counts = np.diff(np.searchsorted(ends, sizes) + 1, prepend=0)
        rest = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in order[sum(words) :]], add_special_tokens=False)]
        counts = np.concatenate([counts, np.array([len(r) for r in rest], np.int64)])
        for n, k in enumerate(order):
            self.place[hashes[k]] = len(self.begin) + n
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32), *[r.astype(np.uint32) for r in rest]])

    def _simple(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts have only ASCII and Latin letters, and no special token's text."""
        lead = np.concatenate([[0], data[:-1]]) == 0xC3
        bad = (data >= 0x80) & ~((data == 0xC3) | (lead & (data < 0xC0) & (data != 0x97) & (data != 0xB7)))
        ok = np.ones(len(offsets) - 1, bool)
        ok[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = False
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                ok[np.searchsorted(offsets, at, side="right") - 1] = False
                at = raw.find(mark, at + 1)
        return ok

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The uint32 ids of each text, in order."""
        data, offsets = buffers(texts)
        for a, b in pieces(offsets, PIECE_BYTES):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            ok = self._simple(part, at)
            starts = _piece_starts(part, at) if len(part) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(part))
            keep = ok[np.searchsorted(at, starts, side="right") - 1]
            starts, ends = starts[keep], ends[keep]
            hashes, first, back = np.unique(run_hashes(part, starts, ends), return_index=True, return_inverse=True)
            if len(self.place) > CACHE:
                self._forget()
            keys = hashes.tolist()
            new = [k for k, h in enumerate(keys) if h not in self.place]
            raw = part.tobytes()
            self._learn([keys[k] for k in new], [raw[starts[i] : ends[i]] for i in first[new].tolist()])
            where = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[back]
            counts = self.count[where]
            done = np.concatenate([[0], np.cumsum(counts)])
            ids = self.flat[np.repeat(self.begin[where] - done[:-1], counts) + np.arange(done[-1])]
            bounds = done[np.searchsorted(starts, at)]
            for k in range(b - a):
                yield ids[bounds[k] : bounds[k + 1]] if ok[k] else np.array(self.tokenizer.encode(raw[at[k] : at[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)


def cut(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of all pieces, unpacked."""

    def cut_pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.at(path)
        end = np.array([end_id], np.uint32)
        for part in parts:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, packed in zip(part.column(0).to_pylist(), ids.of(part.column(1))):
                packed = np.concatenate([packed, end]).astype("<u4").tobytes()
                n = len(packed) // 4
                a, b = 0, n % size or size
                for k in range(-(-n // size)):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(packed[4 * a : 4 * b]))
                    a, b = b, b + size
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        cut_pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Bins of a group of pieces; ``lengths`` are at most ``size``."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins: list[list[int]] = []
        self._best_fit()
        self._search()

    def _best_fit(self) -> None:
        room: list[tuple[int, int]] = []  # (free, bin), sorted
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            at = bisect_left(room, (n, -1))
            if at < len(room):
                free, b = room.pop(at)
                self.bins[b].append(i)
            else:
                free, b = self.size, len(self.bins)
                self.bins.append([i])
            if free > n:
                insort(room, (free - n, b))

    def _search(self) -> None:
        """Exchange pieces between bins while the sum of squared fills grows.

        Every underfull bin gives in turn, emptiest first; of its moves, one-for-one and two-for-one
        exchanges with all other bins the one that adds most is made, until none adds.  The search ends when
        no exchange of any two bins adds, or when no fewer bins can hold the pieces (their length over the size).
        """
        size = self.size
        length = np.array(self.lengths, np.int64)
        bin_of = np.zeros(len(length), np.int64)
        for k, b in enumerate(self.bins):
            bin_of[b] = k
        fill = np.bincount(bin_of, length, len(self.bins)).astype(np.int64)
        least, held, changed = -(-int(length.sum()) // size), len(self.bins), True
        while changed and held > least:
            changed = False
            for x in np.argsort(fill, kind="stable").tolist():
                while 0 < fill[x] < size and held > least and (step := self._step(x, length, bin_of, fill)):
                    give, take, y = step
                    gain = int(length[give].sum() - length[take].sum())
                    bin_of[give], bin_of[take] = y, x
                    fill[x] -= gain
                    fill[y] += gain
                    held -= fill[x] == 0
                    changed = True
        order = np.argsort(bin_of, kind="stable")
        self.bins = [b.tolist() for b in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1) if len(b)]

    def _step(self, x: int, length: np.ndarray, bin_of: np.ndarray, fill: np.ndarray) -> tuple[list[int], list[int], int] | None:
        """Pieces that bin ``x`` gives and takes, and the other bin, of the exchange that adds most; None if none adds."""
        size, own = self.size, np.flatnonzero(bin_of == x)
        single, count = np.unique(length[own], return_counts=True)
        i, j = np.triu_indices(len(single))
        both = (single[i] + single[j])[(i != j) | (count[i] > 1)]
        # the largest amount within each limit, from one piece and from one or two
        one = np.zeros(size + 1, np.int64)
        one[single] = single
        two = one.copy()
        two[both[both <= size]] = both[both <= size]
        one, two = np.maximum.accumulate(one), np.maximum.accumulate(two)
        room = size - fill
        moved = one[room]
        traded = two[np.minimum(length + room[bin_of], size)] - length
        # a net amount t from x to y adds 2 t (fill y - fill x + t) to the sum
        worth = np.concatenate([moved * (fill - fill[x] + moved), traded * (fill[bin_of] - fill[x] + traded)])
        worth[np.concatenate([moved <= 0, traded <= 0])] = 0
        worth[x] = 0
        worth[len(fill) + own] = 0
        best = int(worth.argmax())
        if worth[best] <= 0:
            return None
        y, take, amount = (best, [], int(moved[best])) if best < len(fill) else (int(bin_of[best - len(fill)]), [best - len(fill)], int(traded[best - len(fill)] + length[best - len(fill)]))
        for p in own.tolist():
            if length[p] == amount:
                return [p], take, y
        for p in own.tolist():
            for q in own[own > p].tolist() if length[p] < amount else ():
                if length[p] + length[q] == amount:
                    return [p, q], take, y
        raise AssertionError("an amount stands for one or two pieces")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cutted = cut_lineage(cut(docs, path, size, end_id, id_col, text_col).withColumn("number", F.monotonically_increasing_id()))
    groups = -(-cutted.count() // GROUP) or 1
    dealt = cutted.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number", ignore_index=True)
        lengths = rows.length.tolist()
        short = [i for i, n in enumerate(lengths) if n < size]
        bins = [[short[i] for i in b] for b in Bins([lengths[i] for i in short], size).bins]
        bins += [[i] for i, n in enumerate(lengths) if n == size]
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = k, at
                at += lengths[i]
        rows["sequence_id"] = (int(rows.g[0]) << 32) + sequence
        rows["offset"] = offset
        return rows.drop(columns=["number", "g"])

    # a long column with a null would come to pandas as floats: ids travel as a number and whether there is one
    dealt = dealt.withColumns({"known": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    columns = ["piece int", "start long", "length long", "ids_crc32 long", "sequence_id long", "offset long"]
    filled = dealt.groupBy("g").applyInPandas(fill, ", ".join(["doc_id long", *columns[:4], "known boolean", *columns[4:]]))
    return filled.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), *[c.split()[0] for c in columns])
