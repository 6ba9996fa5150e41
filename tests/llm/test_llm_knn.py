import numpy as np
import pytest

from quire.llm import knn


def plain(rows, k, scale, every):
    ok = [(i, np.array([int(x) for x in np.floor(np.array(v, float) * scale)], object)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            found = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "pivots"), [(2048, 4096, 256), (3, 7, 12), (1, 1000, 1)])
def test_matches_plain_search(spark, monkeypatch, block, chunk, pivots):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "CHUNK", chunk)
    monkeypatch.setattr(knn, "PIVOTS", pivots)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.2).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(40)]  # copies: ties to the smaller id
    rows += [(300, None), (301, []), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(400 + i, r.normal(size=3).tolist()) for i in range(11)] + [(500, [1.0] * 5)]  # other lengths; one alone
    df = spark.createDataFrame([(*x, 0.0, 1) for x in rows], "vec_id long, embedding array<double>, score double, cell int")
    got = [tuple(x) for x in knn.topk(df, k=5, scale=256, every=10).collect()]
    assert sorted(got) == plain(rows, 5, 256, 10)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.integers(-(2**25), 2**25, 6) / 1.0).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in knn.topk(df, k=4, scale=1, every=7).collect()) == plain(rows, 4, 1, 7)


@pytest.mark.parametrize("copies", [1, 6, 10])
def test_repeated_ids_of_queries(spark, monkeypatch, copies):
    """Rows of a query's own id never crowd out its candidates; each row is a query."""
    monkeypatch.setattr(knn, "CHUNK", 5)
    r = np.random.default_rng(7)
    rows = [(0, [50.0, 50.0, 0.0])] * copies + [(i, r.normal(size=3).tolist()) for i in range(1, 40)] + [(3, [1.0, 2.0, 3.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in knn.topk(df, k=5, scale=256, every=10).collect()) == plain(rows, 5, 256, 10)


def test_very_large_components(spark):
    r = np.random.default_rng(8)
    rows = [(i, (r.integers(-(2**30), 2**30, 6) / 1.0).tolist()) for i in range(40)] + [(40 + i, (r.normal(size=6) * 10.0 ** (i % 9)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in knn.topk(df, k=4, scale=1, every=7).collect()) == plain(rows, 4, 1, 7)
    beyond = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [2.0])], "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in knn.topk(beyond, k=3, scale=256, every=50).collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_empty_table(spark):
    assert knn.topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_rule_out_far_groups():
    p = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    near = [0.0] * 6
    blocks, needs = knn.plan(p, {0: (5, 1.0, 101.0)}, {0: (10, 1.0, near), 1: (10, 1.0, near), 2: (10, 1.0, near)}, 5)
    assert blocks == {0: [0]} and needs == {0: {0}}
