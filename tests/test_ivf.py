"""TK2: inverted lists - exact when all are probed, pruned when few are, appended to, calibrated."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import ivf
from quire.operators.ann import recall_at_k
from quire.operators.knn import exact_topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def emb(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


def asked(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def clustered(spark, n=900, centres=30, dim=12):
    r = np.random.default_rng(4)
    c = r.normal(size=(centres, dim))
    rows = [(i, (c[i % centres] + r.normal(size=dim) * 0.1).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_all_lists_are_the_exact_search(spark, emb, tmp_path):
    path = str(tmp_path / "index")
    ivf.build_index(emb, path, rounds=2)
    lists = len(ivf.stored_centroids(spark, path))
    got = ivf.ivf_topk(asked(emb), path, 3, lists, exclude_self=True)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.cosine, 9)) for r in df.collect())
    assert key(got) == key(exact_topk(asked(emb), emb, 3, exclude_self=True))
    assert ivf.compared(asked(emb), path, lists).first().share_compared == 1.0
    with pytest.raises(ValueError):
        ivf.build_index(emb, path)


def test_few_probes_read_few_lists(spark, tmp_path):
    path, vectors = str(tmp_path / "index"), clustered(spark)
    ivf.build_index(vectors, path)
    probes = ivf.calibrate(asked(vectors.where("vec_id % 10 = 0")), path, 3, 0.95, exclude_self=True)
    got = ivf.ivf_topk(asked(vectors), path, 3, probes, exclude_self=True)
    exact = exact_topk(asked(vectors), vectors, 3, exclude_self=True).select("query_id", "vec_id")
    assert recall_at_k(exact, got, 3).first().recall >= 0.95
    assert ivf.compared(asked(vectors), path, probes).first().share_compared < 0.3
    one = ivf.ivf_topk(asked(vectors.where("vec_id = 5")), path, 3, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ = \d+", plan) and [r.vec_id for r in one.collect()][0] == 5


def test_appended_vectors_are_found(spark, tmp_path):
    path, vectors = str(tmp_path / "index"), clustered(spark)
    ivf.build_index(vectors.where("vec_id < 600"), path)
    ivf.add_vectors(vectors.where("vec_id >= 600"), path)
    lists = len(ivf.stored_centroids(spark, path))
    got = ivf.ivf_topk(asked(vectors), path, 2, lists)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == {(r.query_id, r.vec_id) for r in exact_topk(asked(vectors), vectors, 2).collect()}


def test_vectors_without_direction_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.5, 0.1]), (6, [1.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ivf.build_index(df, str(tmp_path / "odd"), n_lists=4)
    got = ivf.ivf_topk(asked(df), str(tmp_path / "odd"), 3, 4, exclude_self=True).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1, 5), (5, 1)]
    stored = spark.read.parquet(str(tmp_path / "odd" / "vectors"))
    assert {r.vec_id for r in stored.where("list = -1").collect()} == {2, 3, 4, 6, 7} and stored.count() == 7
    ivf.build_index(df.where("vec_id = 3"), str(tmp_path / "none"))
    assert ivf.ivf_topk(asked(df), str(tmp_path / "none"), 3, 1).count() == 0


def test_a_query_travels_once_to_a_chunk_of_lists(spark, tmp_path, monkeypatch):
    path, vectors = str(tmp_path / "index"), clustered(spark)
    ivf.build_index(vectors, path, n_lists=20)
    sent = []
    monkeypatch.setattr(ivf, "paired", lambda qb, cb, *a, f=ivf.paired: sent.append((qb.count(), cb.count())) or f(qb, cb, *a))
    got = ivf.ivf_topk(asked(vectors), path, 3, 15, exclude_self=True).count()
    assert got == 2_700 and sent == [(900, 900)]  # not 15 rows a query
    monkeypatch.setattr(ivf, "LIST_CHUNK", 200)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", 300)
    cut = ivf.ivf_topk(asked(vectors), path, 3, 20, exclude_self=True)
    exact = exact_topk(asked(vectors), vectors, 3, exclude_self=True)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(cut) == key(exact)
