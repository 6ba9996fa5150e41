"""ML7/JN8 over token vectors: equal to brute force whatever the windows and packs; ids, nulls and long texts."""

import numpy as np
import pytest

from quire.operators.evaluate import long_scores, vector_scored_items, wide_results
from quire.operators.models import HashingEmbedder
from quire.operators.token_match import TrigramTokens, match_pack, token_match

EMB = TrigramTokens(16)


def brute(ref, cand, emb=EMB):
    if not ref or not cand:
        return None, None
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in emb.vectors([ref, cand])]
    s = unit[1] @ unit[0].T
    return s.max(axis=1).mean(), s.max(axis=0).mean()


def same(got, want):
    return got == want if None in want else np.allclose(got, want, atol=1e-12, rtol=0)


def words(rng, n):
    return ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(n)]


@pytest.mark.parametrize("window,block", [(1, 1), (3, 7), (5, 64), (512, 4096)])
def test_packs_equal_brute_force(window, block):
    rng = np.random.default_rng(7)
    pack = [(words(rng, int(n)), [words(rng, int(c)) for c in cs]) for n, cs in [(9, [4, 0, 11]), (0, [3]), (40, [1, 25]), (6, []), (1, [1])]]
    got = match_pack(EMB.vectors, pack, window, block)
    assert [len(g) for g in got] == [3, 1, 2, 0, 1]
    for (ref, cands), scores in zip(pack, got):
        for cand, score in zip(cands, scores):
            assert same(score, brute(ref, cand))


def test_calls_hold_a_bounded_number_of_tokens():
    rng, asked = np.random.default_rng(1), []

    def vectors(lists):
        asked.append((max(map(len, lists)), sum(map(len, lists))))
        return EMB.vectors(lists)

    match_pack(vectors, [(words(rng, 900), [words(rng, 300), words(rng, 20)])], 50, 200)
    assert max(a for a, _ in asked) <= 50 and max(n for _, n in asked) <= 200
    # small pairs share calls
    asked.clear()
    match_pack(vectors, [(words(rng, 10), [words(rng, 5)]) for _ in range(12)], 50, 200)
    assert len(asked) == 2


def test_zero_vectors_match_nothing_and_sizes_are_checked():
    zero = lambda lists: [np.zeros((len(x), 4)) for x in lists]
    assert match_pack(zero, [(["a"], [["a", "b"]])]) == [[(0.0, 0.0)]]
    with pytest.raises(ValueError, match="vectors for"):
        match_pack(lambda lists: [np.zeros((1, 4)) for _ in lists], [(["a"], [["a", "b"]])])


def test_rows_keep_ids_beside_nulls(spark):
    schema = "id long, precision string, ref array<string>, cands array<struct<name: string, n: long, tokens: array<string>>>"
    big = 2**53 + 1
    rows = [
        (big, "x", ["one", "two"], [("a", big, ["one"]), ("b", None, None)]),
        (None, None, ["one"], [("c", 1, ["two", "one"])]),
        (3, "y", None, [("d", 2, ["one"])]),
        (4, "z", ["one"], []),
        (5, "z", ["one"], None),
        (big + 2, "x", ["one", "two"], [("a", 7, ["one"])]),
    ]
    df = spark.createDataFrame(rows, schema).withColumnRenamed("precision", "label").coalesce(1)
    got = {r.name + str(r.id): r for r in token_match(df, EMB, "ref", "cands", ["id", "label"]).collect()}
    assert set(got) == {f"a{big}", f"b{big}", "cNone", "d3", f"a{big + 2}"}
    assert got[f"a{big}"].n == big and abs(got[f"a{big}"].precision - 1) < 1e-12 and got[f"b{big}"].recall is None and got[f"b{big}"].n is None
    assert got["d3"].precision is None and same((got["cNone"].precision, got["cNone"].recall), brute(["one"], ["two", "one"]))
    empty = token_match(df.where("id = -1"), EMB, "ref", "cands", ["id"])
    assert empty.columns == ["id", "name", "n", "precision", "recall"] and empty.count() == 0


def test_evaluation_by_vectors(spark):
    long_text = " ".join(f"word{i % 211} stem{i % 97}" for i in range(4000))
    docs = spark.createDataFrame(
        [
            (1, "t1", "The cat sat on the mat.", {"default": "a cat, sitting", "recent": "  ", "legacy": "the cat"}),
            (2, "t2", long_text, {"recent": "word1 stem2 other", "achievements": long_text}),
            (3, "t3", " ", {"default": "kept out"}),
            (4, "t4", "no map", None),
            (None, None, "the mat", {"default": "!!"}),
        ],
        "_id long, team string, content string, summaries map<string,string>",
    )
    got = {(r._id, r.summary_type): r for r in vector_scored_items(docs, EMB, HashingEmbedder(32)).collect()}
    assert set(got) == {(1, "default"), (2, "recent"), (2, "achievements"), (None, "default")}
    cat = got[1, "default"]
    assert same((cat.precision, cat.recall), brute(["the", "cat", "sat", "on", "the", "mat"], ["a", "cat", "sitting"]))
    assert cat.item_id == "1:default" and (cat.summary_length, cat.article_length) == (3, 6)
    whole = got[2, "achievements"]
    assert whole.article_length == 8000 and np.allclose((whole.precision, whole.recall, whole.f1, whole.cosine, whole.combined), 1.0)
    assert same((got[2, "recent"].precision, got[2, "recent"].recall), brute(long_text.split(), ["word1", "stem2", "other"]))
    assert got[None, "default"].precision is None and got[None, "default"].combined is None
    scored = vector_scored_items(docs.where("_id is not null"), EMB, HashingEmbedder(32))
    assert wide_results(scored, long_scores(scored)).where("bert_f1 is not null").count() == 3


def test_scores_move_nothing(spark):
    docs = spark.createDataFrame([(1, "t", "a b", {"default": "a"})], "_id long, team string, content string, summaries map<string,string>")
    plan = vector_scored_items(docs, EMB, HashingEmbedder(8))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan and "BatchEvalPython" not in plan


def test_each_trigram_is_hashed_once(monkeypatch):
    import hashlib

    from quire.operators import token_match as tm

    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda b: calls.append(b) or md5(b))
    tm._trigram_place.cache_clear()
    got = tm.TrigramTokens(8).vectors([["abcx", "abcy", "x"], [], ["abcz"]])
    assert len(calls) == len(set(calls)) and [len(m) for m in got] == [3, 0, 1]
    for token, row in zip(["abcx", "abcy", "x"], got[0]):
        marked = f"^{token}$"
        places = [int(md5(marked[i : i + 3].encode()).hexdigest()[:8], 16) % 8 for i in range(len(marked) - 2)]
        assert row.tolist() == np.bincount(places, minlength=8).tolist()
    assert tm.TrigramTokens(8).vectors([[]])[0].shape == (0, 8)
