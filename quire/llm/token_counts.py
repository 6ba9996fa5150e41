"""Count-only Viterbi: how many pieces a unigram tokenizer would cut a text into.

* Words: a blank (or the mark U+2581 that stands for it) begins a word, and
  the text begins one; each word is cut by itself with the mark in front.
* An Aho-Corasick automaton lists every vocabulary piece that ends at each
  character, longest first; dynamic programming carries the best score and
  the number of pieces of the best path to each character, and nothing else.
* Ties as in the tokenizer: a later candidate replaces an earlier one only if
  its score is greater, and candidates come in order of their first
  character.  A character that is no piece itself also costs the lowest score
  less 10 as unknown; an unknown character counts as its UTF-8 bytes where the
  vocabulary has byte pieces, else a run of them counts as one piece.
* Equal words have equal counts: numpy finds the distinct words of a few
  megabytes of text, and a bounded cache remembers their counts by hash.

The vocabulary is read from a file given by its path on each worker.

Defined results: null and empty texts have 0 pieces; rows are returned as
they come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import buffers, pieces, run_hashes

MARK = "▁"
PIECE_BYTES = 4 << 20
CACHE = 1_000_000
_STATE: dict[str, Counter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and log probabilities of a piece file.

    The public file orders its pieces by rank; the rank is read as a Zipf law,
    ``-log(rank + 1)``, byte and control pieces (first in the file) as the last ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    odd = [i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)]
    rank = {i: r for r, i in enumerate([i for i in range(n) if i not in set(odd)] + odd)}
    return [(model.id_to_piece(i), -math.log(rank[i] + 1.0)) for i in range(n)]


class Counter:
    """Counts pieces of words over a vocabulary of ``(piece, score)``."""

    def __init__(self, vocab: list[tuple[str, float]]):
        scores = dict(vocab)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - 10.0
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.cache: dict[int, tuple[int, int]] = {}

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in _STATE:
            _STATE[path] = cls(vocabulary(path))
        return _STATE[path]

    def count(self, word: str) -> tuple[int, int]:
        """(pieces, those of them for unknown characters) of the best path."""
        n = len(word)
        best: list[float] = [0.0] + [-math.inf] * n
        number, missing, open_ = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        end, found = next(matches, (n, None))
        for e in range(n):
            top, came, known = -math.inf, -1, True
            while end == e:
                length, score = found
                s = e + 1 - length
                if best[s] + score > top:
                    top, came = best[s] + score, s
                end, found = next(matches, (n, None))
            if word[e] not in self.single and best[e] + self.unknown > top:
                top, came, known = best[e] + self.unknown, e, False
            best[e + 1] = top
            if known:
                number[e + 1], missing[e + 1] = number[came] + 1, missing[came]
            else:
                more = len(word[e].encode()) if self.bytes else int(not open_[e])
                number[e + 1], missing[e + 1], open_[e + 1] = number[e] + more, missing[e] + more, True
        return number[n], missing[n]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Rows of (pieces, unknown pieces) for the texts, in order, some texts at a time."""
        data, offsets = buffers(pc.replace_substring(texts.cast(pa.large_string()), MARK, " "))
        for a, b in pieces(offsets, PIECE_BYTES):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not len(part):
                yield np.zeros((b - a, 2), np.int64)
                continue
            start = part == 32
            start[at[:-1][at[:-1] < at[1:]]] = True
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], len(part))
            owner = np.searchsorted(at, starts, side="right") - 1
            starts = starts + (part[starts] == 32)  # the blank itself is the mark in front
            hashes, first, back = np.unique(run_hashes(part, starts, ends), return_index=True, return_inverse=True)
            if len(self.cache) > CACHE:
                self.cache.clear()
            raw, keys = part.tobytes(), hashes.tolist()
            for h, i in zip(keys, first.tolist()):
                if h not in self.cache:
                    self.cache[h] = self.count(MARK + raw[starts[i] : ends[i]].decode())
            counts = np.array([self.cache[h] for h in keys], np.int64).reshape(-1, 2)[back]
            yield np.column_stack([np.bincount(owner, counts[:, k], b - a) for k in (0, 1)]).astype(np.int64)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, n_unknown)`` for every row."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(path)
        for part in parts:
            n = np.concatenate([np.zeros((0, 2), np.int64), *counter.of(part.column(1))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n[:, 0]), pa.array(n[:, 1])], [id_col, "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, f"`{id_col}` long, n_tokens long, n_unknown long")
