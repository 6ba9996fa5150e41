"""Vectorised words of a batch of texts: 64-bit word hashes straight from Arrow buffers.

One pass of numpy over the UTF-8 bytes of many texts replaces a Python loop
per word.  A word is a run of bytes that are no separator; separators are the
six ASCII white-space characters or, with ``plain=True``, every ASCII
character that is neither letter nor digit.  A-Z are lower-cased (``plain``
also lower-cases the two-byte Latin letters).  Equal words always have equal
hashes; different words share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: texts are worked on in pieces of about this many bytes, to bound memory
PIECE_BYTES = 1 << 20
#: words over this many bytes are hashed one at a time
LONG_WORD = 2048

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (a bijection)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: hashes, the first word of each text, and byte places."""

    hashes: np.ndarray  # uint64, one per word
    first: np.ndarray  # int64, texts + 1
    starts: np.ndarray  # int64, byte offset in ``data``
    ends: np.ndarray
    data: np.ndarray  # the bytes of the texts, as they are
    offsets: np.ndarray  # int64, texts + 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes (one long text may be more) and ``most`` texts each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(a + most, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1))
        yield a, min(b, n)
        a = min(b, n)


def lowered(data: np.ndarray, plain: bool) -> np.ndarray:
    low = _LOWER[data]
    if plain and len(low) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[wide] += 32
    return low


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, eight bytes at a time."""
    low = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    size = ends - starts
    h = np.full(len(starts), 0x2545F4914F6CDD1D, np.uint64)
    todo, k = np.arange(len(starts)), 0
    while len(todo):
        left = size[todo] - k
        if k == LONG_WORD:
            h[todo] = [xxhash.xxh64_intdigest(low[starts[i] : ends[i]].tobytes()) for i in todo]
            break
        h[todo] = mix(h[todo] ^ (lanes[starts[todo] + k] & _MASK[np.minimum(left, 8)]))
        todo, k = todo[left > 8], k + 8
    return mix(h ^ size.astype(np.uint64))


def split(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> Words:
    """Words of the texts in ``data``; ``offsets`` are relative to it."""
    inside = ~(_PUNCT if plain else _WHITE)[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    finish[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    h = run_hashes(lowered(data, plain), starts, ends)
    return Words(h, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def batches(texts: pa.Array, plain: bool = False, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first text, past the last text, their words) piece by piece."""
    data, offsets = buffers(texts)
    for a, b in pieces(offsets, size):
        yield a, b, split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], plain)


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` successive words (``n`` up to 8)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _FACTORS[k]
    return mix(out ^ np.uint64(n))


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingles of each text; with fewer words, the whole sequence as one."""
    grams = ngrams(words.hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield ngrams(words.hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
