"""JN6/TK1/WN2: exact top-k against numpy brute force; both strategies agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.knn import exact_topk


def brute(q, c, k, groups_q=None, groups_c=None, exclude_self=False):
    out = {}
    for qi, qv in q.items():
        scores = []
        for ci, cv in c.items():
            if exclude_self and ci == qi:
                continue
            if groups_q is not None and groups_q[qi] != groups_c[ci]:
                continue
            if cv is None or len(cv) != len(qv) or not np.linalg.norm(cv):
                continue
            scores.append((-float(np.dot(qv, cv) / np.linalg.norm(qv) / np.linalg.norm(cv)), ci))
        out[qi] = [ci for _, ci in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_embeddings_self_search(spark, strategy):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = emb.collect()
    vecs = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows}
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    got = exact_topk(q, emb, 3, exclude_self=True, strategy=strategy, query_block=37, corpus_block=53).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        res.setdefault(r.query_id, []).append(r.vec_id)
    assert res == brute(vecs, vecs, 3, exclude_self=True)


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_groups_ties_and_bad_vectors(spark, strategy):
    corpus = [
        (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "a"),
        (4, [0.0, 0.0], "a"), (5, None, "a"), (6, [1.0, 0.0, 0.0], "a"), (7, [1.0, 0.1], "b"),
    ]
    cdf = spark.createDataFrame(corpus, "vec_id long, embedding array<float>, g string")
    qdf = spark.createDataFrame([(10, [2.0, 0.0], "a"), (11, [0.0, 0.0], "a"), (12, [1.0, 1.0], "b")], "query_id long, embedding array<float>, g string")
    got = exact_topk(qdf, cdf, 2, group_cols=["g"], strategy=strategy).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(10, 1), (10, 2), (12, 7)]
    assert all(-1 <= r.cosine <= 1.0000001 for r in got)


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_mixed_sizes_and_repeated_ids_in_groups(spark, strategy):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "a"), (1, [0.0, 1.0], "b")], "vec_id long, embedding array<float>, g string")
    queries = spark.createDataFrame(
        [(10, [1.0, 0.1], "a"), (11, [0.0, 2.0, 0.0], "a"), (10, [0.1, 1.0], "b"), (12, [float("inf"), 1.0], "b"), (13, [1.0, 0.0], None)],
        "query_id long, embedding array<float>, g string",
    )
    got = exact_topk(queries, corpus, 3, group_cols=["g"], strategy=strategy).collect()
    assert sorted((r.query_id, r.g, r["rank"], r.vec_id) for r in got) == [(10, "a", 1, 1), (10, "b", 1, 1), (11, "a", 1, 2)]


def test_equal_scores_stay_within_k(spark):
    corpus = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(500, 0, -1)], "vec_id long, embedding array<float>")
    got = exact_topk(corpus.selectExpr("vec_id as query_id", "embedding").limit(50), corpus, 3, strategy="blocked").collect()
    assert len(got) == 150 and {r.vec_id for r in got} == {1, 2, 3}


def test_scores_of_a_block_are_never_held_at_once():
    import tracemalloc

    import pandas as pd

    from quire.operators.knn import _as_matrix, _score_block

    x = np.random.default_rng(3).normal(size=(20_000, 8))
    cdf = pd.DataFrame({"vec_id": np.arange(20_000), "embedding": list(x)})
    q, _ = _as_matrix(cdf["embedding"][:2_000])
    tracemalloc.start()
    got = _score_block(np.arange(2_000), q, cdf, "vec_id", "embedding", 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(got) == 6_000  # all scores: 320 MB
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for query in (0, 7, 1_999):
        s = unit @ unit[query]
        s[query] = -9
        mine = got[got["query_id"] == query].sort_values("cosine", ascending=False)
        assert mine["vec_id"].tolist() == np.argsort(-s)[:3].tolist() and np.allclose(mine["cosine"], np.sort(s)[::-1][:3])


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_copies_take_the_lowest_ids(spark, strategy):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(i, [1.0, 2.0]) for i in (3, 3, 3, 3, 3)] + [(90 + i, [2.0, 1.0 + i]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id in (0, 2, 20, 90)").selectExpr("vec_id as query_id", "embedding")
    got = exact_topk(queries, df, 3, exclude_self=True, strategy=strategy).orderBy("query_id", "rank").collect()
    hits = {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 2, 20)}
    assert hits == {q: [i for i in (0, 1, 2, 3, 3) if i != q][:3] for q in (0, 2, 20)}
