"""LM scoring: exact base scores, and the trie against a plain back-off model."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import lm
from quire.llm.words import split


def plain(rows, share):
    """(n_tokens, n_known, N, base, score) by the definitions, with dictionaries."""
    toks = [(t or "").encode().lower().split() + [None] for _, t, _ in rows]
    learn = [w for w, (_, _, held) in zip(toks, rows) if not held]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    least = max(2, -(-n // 2**share))
    hot = {x for x, k in c.items() if k >= least}
    c2 = Counter((a, b) for w in learn for a, b in zip(w, w[1:]) if {a, b} <= hot)
    c3 = Counter(x for w in learn for x in zip(w, w[1:], w[2:]) if {*x} <= hot)
    c2, c3 = ({k: m for k, m in x.items() if m >= least} for x in (c2, c3))
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    sums = [defaultdict(float) for _ in range(4)]
    for (a, b), k in c2.items():
        sums[0][a] += (k - 0.75) / c[a]
        sums[1][a] += p1(b)
    for (a, b, e), k in c3.items():
        sums[2][a, b] += (k - 0.75) / c2[a, b]
        sums[3][a, b] += (c2[b, e] - 0.75) / c[b]
    back = lambda s, low: max(1 - s, 1e-9) / max(1 - low, 1e-9)

    def p(t, u, w):
        if (t, u, w) in c3:
            return (c3[t, u, w] - 0.75) / c2[t, u]
        x = back(sums[2][t, u], sums[3][t, u]) if (t, u) in c2 else 1
        if (u, w) in c2:
            return x * (c2[u, w] - 0.75) / c[u]
        return x * (back(sums[0][u], sums[1][u]) if u in hot else 1) * p1(w)

    none = object()
    out = []
    for w in toks:
        s = sum(math.log10(p(w[i - 2] if i > 1 else none, w[i - 1] if i else none, w[i])) for i in range(len(w)))
        out.append((len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), s))
    return out


@pytest.mark.parametrize("piece", [200, 8 << 20])
def test_matches_plain_model(spark, monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "中"]
    rows = [(k, " ".join(rnd.choice(vocab[: 1 + k % 43]) for _ in range(rnd.randint(0, 60))) + (f" once{k}" if k % 3 else ""), k % 7 == 2) for k in range(150)]
    rows += [(200, None, False), (201, "", True), (200, "W1 w2", False), (None, "w1 unseen", True), (None, None, True), (202, "never seen at all", True), (203, "x" * 9000, False)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, held_out boolean, score double").repartition(3)
    got = sorted(map(tuple, lm.score_documents(df).select("n_tokens", "n_known", "train_tokens", "base_score", "score", "doc_id", "held_out").collect()), key=lambda r: (str(r[5]), r[0], r[3]))
    want = sorted(((*p, r[0], r[2]) for p, r in zip(plain(rows, lm.SHARE), rows)), key=lambda r: (str(r[5]), r[0], r[3]))
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in got] == [(r[0], r[1], r[2], r[5], r[6]) for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])
    # logarithms are quantised: a small error for each token
    assert max(abs(g[4] - w[4]) / w[0] for g, w in zip(got, want)) < 0.01


def test_mapped_trie_is_the_built_one():
    words = np.array([3, 9, 27, 81], np.uint64)
    two = (np.array([(0 << 20) | 1, (0 << 20) | 3, (2 << 20) | 0]), np.array([4, 2, 5]))
    three = (np.array([(2 << 40) | (0 << 20) | 1, (2 << 40) | (0 << 20) | 3]), np.array([3, 2]))
    built = lm.Trie.build(words, np.array([9, 4, 6, 3]), two, three, 22, 4)
    mapped = lm.Trie.mapped(*built.buffer())
    ids, first = np.array([2, 0, 1, -1, 2, 0, 3, 0]), np.array([0, 4, 7, 8])
    assert np.array_equal(built.score(ids, first), mapped.score(ids, first))
    assert np.isclose(mapped.score(ids, first)[2], math.log10((3 - 0.75) / 5), atol=0.01)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = lm.score_documents(df).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert lm.score_documents(df.where(F.lit(False))).count() == 0


def test_stored_ngrams_do_not_depend_on_the_size(spark, monkeypatch):
    """With more tokens than the frequent words' share allows for, n-grams of two occurrences still count."""
    monkeypatch.setattr(lm, "SHARE", 7)
    rnd = random.Random(11)
    rows = [(k, " ".join(f"w{int(rnd.paretovariate(0.7)) % 90}" for _ in range(30)), k % 7 == 2) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r for r in lm.score_documents(df).collect()}
    want = plain(rows, 30)
    assert -(-want[0][2] // 2**7) > 30
    assert all(np.isclose(got[r[0]].base_score, w[3]) and abs(got[r[0]].score - w[4]) / w[0] < 0.01 for r, w in zip(rows, want))


def test_a_hot_middle_word_is_dealt_over_shards(spark):
    """A third of all tokens are one word: its trigrams lie in several shards and give the scores of one model."""
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice(["the", f"a{rnd.randint(0, 30)}", f"b{rnd.randint(0, 30)}"]) for _ in range(80)), k % 7 == 2) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    _, model, _, _, deal, _, _ = lm.train(df.select("text", (~F.col("held_out")).alias("train")))
    word = split(np.frombuffer(b"the", np.uint8), np.array([0, 3])).hashes
    assert len(deal.all(word.tobytes())) > 1 and model.count() > 1
    got = {r.doc_id: r for r in lm.score_documents(df).collect()}
    assert all(np.isclose(got[r[0]].base_score, w[3]) and abs(got[r[0]].score - w[4]) / w[0] < 0.01 for r, w in zip(rows, plain(rows, 30)))


def test_gain_is_the_score_less_the_words_own(spark):
    """The scoring by triples agrees with the scoring of whole texts."""
    rnd = np.random.default_rng(3)
    text = rnd.zipf(1.5, 4000) % 30
    words, counts = np.arange(30, dtype=np.uint64) * np.uint64(7), np.bincount(text, minlength=30)
    two, three = (np.unique(x, return_counts=True) for x in ((text[:-1] << 20) | text[1:], (text[:-2] << 40) | (text[1:-1] << 20) | text[2:]))
    kept2, kept3 = (tuple(a[x[1] > 1] for a in x) for x in (two, three))
    trie = lm.Trie.build(words, counts, kept2, kept3, len(text), 30)
    known = np.append(rnd.permutation(30), -1)
    t, u, w = rnd.integers(0, 31, (3, 500))
    order = lm._order3(t, u, w, 31)
    t, u, w = t[order], u[order], w[order]
    whole = trie.score(known[np.stack([t, u, w], axis=1).ravel()], np.arange(0, 1501, 3))[2::3]
    own = np.where(known[w] >= 0, trie.unigram[known[w]], 0.0)
    assert np.allclose(trie.gain(known, t, u, w), whole - own)
