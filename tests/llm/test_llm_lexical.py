"""Ranked search: every query's best documents against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm.lexical import Shard, rank_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=20):
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := split(t))]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 25 + 25 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_terms", "shard"), [(1 << 17, 1 << 20), (5, 50)])
def test_odd_rows(spark, odd_docs, block_terms, shard):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "Alpha beta beta gamma"), (2, "the of and to"), (2, "the of and to"), (3, None), (4, "..."), (5, "nowhere else"), (None, docs[40][1]), (6, "é中🎉 ñ ÀÉ a b"), (7, docs[50][1])]
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS number", "2 AS term", "'x' AS doc_id")
    got = rank_documents(odd_docs, queries, block_terms=block_terms, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(docs, items)


def test_many_copies_and_small_intervals(spark, monkeypatch):
    """Copies of equal score and lists far longer than an interval that is scored whole."""
    from quire.llm import lexical

    monkeypatch.setattr(lexical, "LEAF", 8)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choices(words, range(30, 0, -1), k=rnd.randint(1, 25)))) for i in range(300)]
    docs += [(1000 - i, "w0 w1 w2 w29") for i in range(150)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(12)] + [(50, "w29 w0")]
    doc_frame, item_frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 20):
        assert sorted([tuple(r) for r in rank_documents(doc_frame, item_frame, k).collect()], key=str) == plain(docs, items, k)


def test_best_first_opens_few_intervals(monkeypatch):
    """A shard in which one document stands out is not scored whole."""
    n = 100_000
    rnd = np.random.default_rng(1)
    doc, term = np.concatenate([np.arange(n), [777]]), np.concatenate([np.zeros(n, int), [1]])
    impact = np.concatenate([rnd.integers(1, 1000, n), [10**6]])
    shard, opened = Shard(np.arange(n), doc, term, impact, 2), []
    largest = Shard.largest
    monkeypatch.setattr(Shard, "largest", lambda self, a, b: opened.append(a.size) or largest(self, a, b))
    score, ids = shard.search(np.array([0, 1]), np.array([1, 1]), 1, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert ids.tolist() == [777] and score.tolist() == [10**6 + impact[777]]
    assert sum(opened) < 50 and not shard.sums.any()


def test_range_maximum_names_the_largest():
    rnd = np.random.default_rng(2)
    impact = rnd.integers(1, 50, 500)
    shard = Shard(np.arange(500), np.arange(500), np.zeros(500, int), impact, 1)
    a = rnd.integers(0, 500, 300)
    b = np.minimum(a + rnd.integers(0, 200, 300), 500)
    at = shard.largest(a[:, None], b[:, None])[:, 0]
    assert all((x == -1) if i == j else i <= x < j and impact[x] == impact[i:j].max() for i, j, x in zip(a, b, at))


def test_empty_tables(spark, odd_docs, no_docs):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert rank_documents(odd_docs, none).count() == 0
    assert rank_documents(no_docs, some).count() == 0
