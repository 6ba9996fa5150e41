"""AG8/ML7-ML9: lexical scores vs brute force, greedy vector match vs numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.metrics import check_weights, greedy_match, lexical_scores


def terms(s):
    import regex

    out = []
    for w in s.split():
        t = regex.sub(r"\A[\p{P}\p{S}]+|[\p{P}\p{S}]+\Z", "", w).lower()
        if t:
            out.append(t)
    return out


def brute(c, r):
    ct, rt = terms(c), terms(r)
    cs, rs = set(ct), set(rt)
    p = sum(t in rs for t in ct) / len(ct)
    rec = sum(t in cs for t in rt) / len(rt)
    f1 = 2 * p * rec / (p + rec) if p + rec > 0 else 0.0
    cc, rc = Counter(ct), Counter(rt)
    cos = sum(cc[t] * rc[t] for t in cc) / math.sqrt(sum(v * v for v in cc.values())) / math.sqrt(sum(v * v for v in rc.values()))
    return p, rec, f1, cos


def test_lexical_matches_brute_force(spark):
    refs = [(1, "The cat sat on the mat. The end!"), (2, "Alpha beta, gamma; delta"), (3, "   ")]
    items = [(10, 1, "the CAT, sat."), (11, 1, "dog"), (12, 2, "gamma alpha alpha zeta"), (13, 3, "anything"), (14, 2, "  ")]
    r = spark.createDataFrame(refs, "doc_id long, reference string")
    i = spark.createDataFrame(items, "item_id long, doc_id long, candidate string")
    got = {x.item_id: x for x in lexical_scores(i, r).collect()}
    for item_id, doc_id, cand in items:
        ref = dict(refs)[doc_id]
        if not cand.strip() or not ref.strip():
            assert got[item_id].error and got[item_id].f1 is None
            continue
        p, rec, f1, cos = brute(cand, ref)
        g = got[item_id]
        assert g.error is None
        assert abs(g.precision - p) < 1e-12 and abs(g.recall - rec) < 1e-12
        assert abs(g.f1 - f1) < 1e-12 and abs(g.cosine - cos) < 1e-12
        if p > 0 and rec > 0:
            assert min(p, rec) - 1e-12 <= g.f1 <= max(p, rec) + 1e-12


def test_greedy_match_vs_numpy(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cand = emb.select("vec_id", "embedding", F.col("label").alias("pair_id"))
    ref = emb.select("vec_id", "embedding", F.pmod(F.col("label") - 1, F.lit(10)).alias("pair_id"))
    got = {r.pair_id: r for r in greedy_match(cand, ref).collect()}
    rows = emb.collect()
    by = {}
    for r in rows:
        v = np.array(r.embedding, dtype=np.float64)
        by.setdefault(r.label, []).append(v / np.linalg.norm(v))
    for c in range(10):
        a, b = np.stack(by[c]), np.stack(by[(c + 1) % 10])
        s = a @ b.T
        p, rec = s.max(axis=1).mean(), s.max(axis=0).mean()
        assert abs(got[c].precision - p) < 1e-9 and abs(got[c].recall - rec) < 1e-9
        assert abs(got[c].f1 - 2 * p * rec / (p + rec)) < 1e-9


def test_weight_check():
    check_weights(0.6, 0.4)
    with pytest.raises(ValueError):
        check_weights(0.7, 0.4)


def test_term_scores_of_slices_equal_those_of_single_items(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    import pyarrow as pa

    from quire.operators import metrics

    rng = random.Random(3)
    side = lambda most: [None if rng.random() < 0.1 else rng.choices(["a", "b", "c", "é", "", None], k=rng.randrange(most)) for _ in range(200)]
    c, r = side(6), side(40)
    monkeypatch.setattr(metrics, "TERMS_AT_ONCE", 50)
    got = metrics._scores(pa.array(c), pa.array(r)).to_pylist()
    for ours, theirs, g in zip(c, r, got):
        if not ours or not theirs:
            assert g == {"precision": None, "recall": None, "cosine": None}
            continue
        a, b = Counter(ours), Counter(theirs)
        cos = sum(n * b[t] for t, n in a.items()) / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values())))
        assert g == {"precision": sum(t in b for t in ours) / len(ours), "recall": sum(t in a for t in theirs) / len(theirs), "cosine": cos}
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(c, r))], "i int, c array<string>, r array<string>")
    assert [s.asDict() for _, s in sorted(rows.select("i", metrics.term_scores("c", "r").alias("s")).collect())] == got
    assert len(metrics._scores(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string())))) == 0


def test_counting_a_batch_holds_a_slice_of_its_terms():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quire.operators import metrics

    n, words = 3_000, 1_000
    terms = pa.array([f"word{i}" for i in range(5_000)]).take(pa.array(np.arange(n * words) * 7 % 5_000))
    references = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), terms)
    candidates = references.slice(0, n)
    tracemalloc.start()
    out = metrics._scores(candidates, references)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == n and out[0].as_py()["precision"] == 1.0
    assert peak < 100e6  # 6 million strings would be some 400 MB
