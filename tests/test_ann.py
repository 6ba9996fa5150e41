"""TK2: candidates over byte codes + exact re-rank; properties from the survey's test plan."""

import pytest
from pyspark.sql import functions as F

from quire.operators.ann import approx_topk, recall_at_k
from quire.operators.knn import exact_topk

SF = "/root/testdata/sf0.001"


def _q(emb):
    return emb.select(F.col("vec_id").alias("query_id"), "embedding")


def _emb(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


def test_all_candidates_equal_exact(spark):
    emb = _emb(spark)
    exact = sorted((r.query_id, r["rank"], r.vec_id) for r in exact_topk(_q(emb), emb, 3, exclude_self=True).collect())
    approx = approx_topk(_q(emb), emb, 3, num_candidates=emb.count(), exclude_self=True).collect()
    assert exact == sorted((r.query_id, r["rank"], r.vec_id) for r in approx)


def test_every_query_has_k_hits_and_recall_is_high(spark):
    emb = _emb(spark)
    exact = exact_topk(_q(emb), emb, 3, exclude_self=True)
    approx = approx_topk(_q(emb), emb, 3, num_candidates=10, exclude_self=True)
    per_query = [r["count"] for r in approx.groupBy("query_id").count().collect()]
    assert len(per_query) == emb.count() and set(per_query) == {3}
    assert recall_at_k(exact.select("query_id", "vec_id"), approx, 3).first().recall >= 0.95


def test_fewer_candidates_than_hits_is_refused(spark):
    with pytest.raises(ValueError):
        approx_topk(_q(_emb(spark)), _emb(spark), 3, num_candidates=2)


def test_vectors_without_direction_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.5, 0.1])], "vec_id long, embedding array<float>")
    got = approx_topk(_q(df), df, 1, num_candidates=2, exclude_self=True).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1, 5), (5, 1)]
