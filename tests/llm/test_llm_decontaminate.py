import random
import re

import numpy as np

from quire.llm import decontaminate, queries
from quire.llm.decontaminate import align, contaminated


def plain_align(item, doc):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for i in range(len(item)):
        for j in range(len(doc)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if item[i] == doc[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(2)
    for _ in range(200):
        item, doc = r.integers(0, 4, r.integers(0, 12)).astype(np.uint64), r.integers(0, 4, r.integers(0, 25)).astype(np.uint64)
        score, a, b = align(item, doc)
        assert score == plain_align(item, doc)
        assert plain_align(item, doc[a:b]) == score and 0 <= a <= b <= len(doc)


def _words(rnd, n):
    return ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def test_copies_edits_and_clean_documents(spark):
    rnd = random.Random(9)
    items = [(k, " ".join(_words(rnd, 30))) for k in range(6)] + [(6, "two words"), (7, None), (8, ""), (0, "Same id, other words are here: one two three four five")]
    docs = [(k, " ".join(_words(rnd, 200))) for k in range(30)]
    first = items[0][1].split()
    edited = [("swapped" if i % 7 == 3 else w) for i, w in enumerate(first)]
    cut = first[:10] + first[12:]
    docs += [(100, " ".join(_words(rnd, 50) + first + _words(rnd, 50))), (101, "; ".join(w.upper() for w in first)), (102, " ".join(_words(rnd, 9) + edited)), (103, " ".join(cut + _words(rnd, 5)))]
    docs += [(104, " ".join(first[:8] + _words(rnd, 40))), (105, None), (106, ""), (100, "a clean text of the same id and nothing else")]
    docs += [(200 + k, items[1][1] + " " + " ".join(_words(rnd, 20))) for k in range(40)]  # most documents hold item 1
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 0), (101, 0), (102, 0), (103, 0)} | {(200 + k, 1) for k in range(40)}
    assert {r.doc_id for r in got if r.score == 1.0} == {100, 101} | {200 + k for k in range(40)}
    place = next(r for r in got if r.doc_id == 100)
    assert (place.first_word, place.last_word) == (50, 80)
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_edited_copy_beside_exact_copies(spark):
    """What else the corpus holds does not decide whether an edited copy is found."""
    words = _words(random.Random(5), 30)
    edited = " ".join("swapped" if i in (6, 13, 20, 27) else w for i, w in enumerate(words))
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for exact in (0, 1, 2, 50):
        d = spark.createDataFrame([(0, edited)] + [(1 + k, " ".join(words)) for k in range(exact)], "doc_id long, text string")
        got = {r.doc_id: r.score for r in contaminated(d, b).collect()}
        assert set(got) == set(range(exact + 1)) and got[0] == 0.8


def test_ids_beyond_doubles_beside_a_null(spark):
    words = " ".join(_words(random.Random(5), 30))
    d = spark.createDataFrame([(2**53 + 1, words), (None, words), (2**53 + 3, words)], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(2**53 + 5, words), (None, words)], "item_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}
    assert got == {(x, y) for x in (2**53 + 1, None, 2**53 + 3) for y in (2**53 + 5, None)}


def test_common_phrase_makes_no_candidates(spark, monkeypatch):
    """A phrase of an item that stands in nine of ten documents joins none of them; copies are found beside it."""
    rnd = random.Random(6)
    phrase, rest = _words(rnd, 4), _words(rnd, 26)
    edited = [w if i % 6 else "swapped" for i, w in enumerate(rest)]
    docs = [(k, " ".join(_words(rnd, 30) + (phrase if k % 10 else []) + _words(rnd, 30))) for k in range(300)]
    docs += [(1000, " ".join(phrase + rest)), (1001, " ".join(_words(rnd, 5) + phrase + edited)), (1002, " ".join(rest[:20]))]
    items = spark.createDataFrame([(1, " ".join(phrase + rest)), (2, " ".join(phrase))], "item_id long, text string")
    frame, seen = spark.createDataFrame(docs, "doc_id long, text string"), []
    kept = decontaminate.rare_pairs
    monkeypatch.setattr(decontaminate, "rare_pairs", lambda *a: seen.append(kept(*a)) or seen[-1])
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, items).collect()}
    # the short item is nothing but the phrase: it keeps its one seed, and the documents do hold it
    assert got == {(d, 1) for d in (1000, 1001, 1002)} | {(d, 2) for d, t in docs if " ".join(phrase) in t}
    assert seen[0].groupBy("item").count().where("count < 10").count() == 1


def test_whole_query_against_all_pairs(spark):
    """Every document against every item, by plain alignment, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    docs = [(r.doc_id, split(r.text)) for r in queries.table(spark, sf, "documents").collect()]
    items = [(r.item_id, split(r.text)) for r in queries.table(spark, sf, "benchmark").collect()]
    number = {}
    coded = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.uint64)
    docs, items = [(d, coded(w)) for d, w in docs], [(i, coded(w)) for i, w in items]
    want = set()
    for i, x in items:
        for d, y in docs:
            if len(x) >= 4 and np.isin(x, y).mean() >= 0.5 and align(x, y)[0] >= 0.5 * 2 * len(x):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf).collect()} == want and want
