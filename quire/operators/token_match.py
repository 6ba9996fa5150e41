"""Greedy token matching of candidates with a reference, over token vectors (ML7, AG8, JN8).

A token embedder is the plug point of a contextual encoder:

* ``tokens(text) -> Column``: the text's tokens, cut in the JVM (``ARRAY<STRING>``);
* ``vectors(token_lists) -> list of matrices``: one row a token, called in tasks.

Every row holds one reference and all its candidates, so a reference is
embedded once for them.  Rows of an Arrow batch are packed until they hold
``block`` tokens and embedded by one call; all candidates of a reference are
one matrix, and the best match of each reference token within each candidate
is a segment maximum of one product.  There is no row per pair of tokens, no
group per pair of texts and no shuffle.

Texts of any length are matched whole: encoders read windows of at most
``window`` tokens, and a task holds at most ``block`` candidate vectors, the
reference vectors of one call and one best value per token.

Cases: a candidate or reference without tokens has NULL scores; a token whose
vector is zero matches nothing (0); rows without candidates give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import lower_terms

#: tokens an encoder reads at once, and tokens embedded by one call
WINDOW = 512
BLOCK = 4_096


class TrigramTokens:
    """Offline stand-in for a contextual encoder: hashed character trigrams of each token, marked at its ends.

    A trigram's place is the first 8 hex digits of its md5, modulo ``dim``; the vector counts places.
    """

    def __init__(self, dim: int = 32):
        self.dim = dim

    def tokens(self, text: Column | str) -> Column:
        return lower_terms(text)

    def vectors(self, token_lists: Sequence[Sequence[str]]) -> list[np.ndarray]:
        rows: dict[str, int] = {}  # each distinct token of the call has one row
        at = [np.array([rows.setdefault(t, len(rows)) for t in tokens], dtype=np.int64) for tokens in token_lists]
        place, dim = _trigram_place, self.dim
        places = [place(marked[i : i + 3], dim) for marked in (f"^{t}$" for t in rows) for i in range(len(marked) - 2)]
        row = np.repeat(np.arange(len(rows)), np.array([len(t) for t in rows], dtype=np.int64))  # a token has as many trigrams as characters
        m = np.bincount(row * dim + np.array(places, dtype=np.int64), minlength=len(rows) * dim).reshape(len(rows), dim).astype(np.float64)
        return [m[i] for i in at]


@lru_cache(maxsize=1 << 16)
def _trigram_place(trigram: str, dim: int) -> int:
    import hashlib

    return int(hashlib.md5(trigram.encode()).hexdigest()[:8], 16) % dim


@dataclass
class _Text:
    """A token list and the best match of each of its tokens (a reference: within each candidate)."""

    pair: int
    part: int
    tokens: list[str]
    best: np.ndarray


def _calls(texts: list[_Text], window: int, block: int) -> Iterator[list[tuple[_Text, int, int]]]:
    """Windows ``(text, start, end)`` of the texts in order, as many to a call as hold ``block`` tokens."""
    call, held = [], 0
    for text in texts:
        for start in range(0, len(text.tokens), window):
            end = min(start + window, len(text.tokens))
            if call and held + end - start > block:
                yield call
                call, held = [], 0
            call.append((text, start, end))
            held += end - start
    if call:
        yield call


def _embedded(vectors: Callable, call: list[tuple[_Text, int, int]]) -> list[tuple[_Text, int, int, np.ndarray]]:
    """The windows of a call with their vectors at unit length (zero vectors stay zero)."""
    out = []
    for (text, start, end), m in zip(call, vectors([text.tokens[start:end] for text, start, end in call]), strict=True):
        m = np.asarray(m, dtype=np.float64)
        if len(m) != end - start:
            raise ValueError(f"the token embedder returned {len(m)} vectors for {end - start} tokens")
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        out.append((text, start, end, np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)))
    return out


def match_pack(vectors: Callable, pack: list[tuple[list[str], list[list[str]]]], window: int = WINDOW, block: int = BLOCK) -> list[list[tuple[float | None, float | None]]]:
    """(precision, recall) of every candidate of every ``(reference tokens, candidates' tokens)`` pair of a pack."""
    references, candidates = {}, []
    for pair, (reference, others) in enumerate(pack):
        if reference:
            references[pair] = _Text(pair, 0, reference, np.full((len(others), len(reference)), -np.inf))
            candidates += [_Text(pair, part, c, np.full(len(c), -np.inf)) for part, c in enumerate(others) if c]
    for ccall in _calls(candidates, window, block):
        ours: dict[int, list] = {}
        for text, start, end, m in _embedded(vectors, ccall):
            ours.setdefault(text.pair, []).append((text, start, end, m))
        stacked = {pair: np.concatenate([m for *_, m in windows]) for pair, windows in ours.items()}
        for rcall in _calls([references[pair] for pair in ours], window, block):
            for ref, start, end, m in _embedded(vectors, rcall):
                cosines = stacked[ref.pair] @ m.T
                windows = ours[ref.pair]
                starts = np.cumsum([0, *[e - s for _, s, e, _ in windows[:-1]]])
                for (text, s, e, _), at, column in zip(windows, starts, np.maximum.reduceat(cosines, starts, axis=0), strict=True):
                    row = cosines[at : at + e - s].max(axis=1)
                    np.maximum(text.best[s:e], row, out=text.best[s:e])
                    np.maximum(ref.best[text.part, start:end], column, out=ref.best[text.part, start:end])
    scores = [[(None, None)] * len(others) for _, others in pack]
    for text in candidates:
        scores[text.pair][text.part] = (float(text.best.mean()), float(references[text.pair].best[text.part].mean()))
    return scores


def token_match(
    rows: DataFrame,
    embedder,
    reference: str,
    candidates: str,
    keep: Sequence[str] = (),
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """One row per candidate: ``keep`` columns, the candidate's other fields, ``precision`` and ``recall``.

    ``reference`` is an ``ARRAY<STRING>`` column, ``candidates`` an
    ``ARRAY<STRUCT<tokens: ARRAY<STRING>, ...>>`` column.  Everything but the
    tokens stays in Arrow, so ids keep their value beside NULLs.
    """
    if window < 1 or block < window:
        raise ValueError("window must be at least 1 and at most block")
    element = rows.schema[candidates].dataType.elementType
    others = [f for f in element.fields if f.name != "tokens"]
    scores = [T.StructField(n, T.DoubleType()) for n in ("precision", "recall")]
    schema = T.StructType([*[rows.schema[c] for c in keep], *others, *scores])

    def scored(batch: pa.RecordBatch, n: int) -> pa.RecordBatch | None:
        lists = batch.column(n + 1)
        sizes = [s or 0 for s in pa.compute.list_value_length(lists).to_pylist()]
        if not sum(sizes):
            return None
        flat = lists.flatten()
        tokens, refs = flat.field("tokens"), batch.column(n)
        found, pack, held, at = [], [], 0, 0
        for i, size in enumerate(sizes):
            if not size:
                continue
            ref = refs[i].as_py() or []
            cands = [tokens[at + k].as_py() or [] for k in range(size)]
            at += size
            here = len(ref) + sum(map(len, cands))
            if pack and held + here > block:
                found += match_pack(embedder.vectors, pack, window, block)
                pack, held = [], 0
            pack.append((ref, cands))
            held += here
        found += match_pack(embedder.vectors, pack, window, block)
        pairs = [p for of_row in found for p in of_row]
        parents = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = [batch.column(j).take(parents) for j in range(n)]
        columns += [flat.field(f.name) for f in others]
        columns += [pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401 - ``pa.compute`` in the worker

        for batch in batches:
            out = scored(batch, len(keep))
            if out is not None:
                yield out

    return rows.select(*keep, F.col(reference), F.col(candidates)).mapInArrow(task, schema)
