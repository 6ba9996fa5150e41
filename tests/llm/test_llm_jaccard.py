"""Jaccard join: exact components, sizes and links against a plain comparison of all texts."""

import itertools

import pytest

from quire.llm import graph
from quire.llm.jaccard import jaccard_components


def plain(rows, n, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = {s: [d for d, t in rows if d is not None and shingles(t) == s] for s in {shingles(t) for _, t in rows}}
    keys = [s for s in sets if s and sets[s]]
    root = {s: s for s in keys}

    def find(s):
        return s if root[s] is s else find(root[s])

    links = dict.fromkeys(keys, 0)
    for a, b in itertools.combinations(keys, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for s in keys:
        low[find(s)] = min(low.get(find(s), sets[s][0]), *sets[s])
    out = []
    for d, t in rows:
        s = shingles(t)
        out.append((d, len(s), None if d is None else links.get(s, 0), None if d is None else low[find(s)] if s else d))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_matches_plain_comparison(spark, odd_docs, n, percent):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in jaccard_components(odd_docs, n, percent).select("doc_id", "n_shingles", "n_links", "component_id").collect()]
    assert sorted(got, key=str) == plain(rows, n, percent)


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):  # each links with its neighbours only
        words = list(words)
        words[5 * k] = f"new{k}"
        rows.append((k, " ".join(words)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {tuple(r[:2]) for r in got} == {(k, 58) for k in range(12)}
    assert {(r.doc_id, r.n_links, r.component_id) for r in got} == {(d, l, c) for d, _, l, c in plain(rows, 3, 90)}
    assert len({r.component_id for r in got}) < 12


def test_empty_table(no_docs):
    assert jaccard_components(no_docs).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100), (101, 100), (100, 101), (None, 5), (200, 150), (150, 170)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 150: 150, 170: 150, 200: 150}
