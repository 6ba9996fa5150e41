"""SimHash: fingerprints and components against a plain comparison of all rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import queries, simhash
from quire.llm.simhash import class_links, forest, signatures, simhash_components, wildcards

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, most=4):
    """Component number of each distinct fingerprint."""
    left, root = set(prints), {}
    while left:
        todo = [left.pop()]
        top = todo[0]
        while todo:
            x = todo.pop()
            root[x] = top
            near = [y for y in left if (x ^ y).bit_count() <= most]
            left.difference_update(near)
            todo += near
    return root


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    root, low = plain_roots(prints), {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            low[root[p]] = min(d, low.get(root[p], d))
    return sorted([(d, f"{p:016x}", low.get(root[p])) for (d, _), p in zip(rows, prints)], key=str)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = simhash_components(odd_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows)


def test_whole_table_matches_plain_comparison(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = [tuple(r) for r in queries.op13_simhash_near_dedup(spark, sf).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert len({c for _, _, c in got}) < len(rows)


@pytest.mark.parametrize("block", [50, 4096])
def test_links_of_a_tight_cluster_and_of_strangers(spark, block):
    """Every pair within 4 bits is reached, whether its keys are solved in one block or in many."""
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 4) for _ in range(40)}
    far = {rnd.getrandbits(64) for _ in range(200)}
    chain = [0]
    for k in range(10):
        chain.append(chain[-1] ^ sum(1 << b for b in rnd.sample(range(64), 4)))
    prints = near | far | set(chain)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    root = {p: p for p in prints}

    def find(x):
        return x if root[x] == x else find(root[x])

    for r in class_links(frame, 4, block).collect():
        a, b = (int(np.int64(x).view(np.uint64)) for x in r)
        root[find(a)] = find(b)
    want = plain_roots(prints)
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == k) for k in {f(p) for p in prints})
    assert groups(find) == groups(want.get)


def test_pairs_within_four_bits_share_a_key():
    """The 67 keys hold, for any four bits, a pair's one differing bit as wildcard or an equal segment."""
    rnd = random.Random(3)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(1, 4)))
        shared = []
        for s, (low, size) in enumerate(simhash.segments()):
            x, y = (a >> low) & ((1 << size) - 1), (b >> low) & ((1 << size) - 1)
            for v in range(size + 1):
                drop = ~(1 << (v - 1)) if v else -1
                if x & drop == y & drop:
                    key = np.array([(x & drop) | (s * 32 + v) << 22], np.int32)
                    wild = int(wildcards(key)[0])
                    shared.append(not wild or (a ^ b) & wild)
        assert any(shared)


def test_signatures_are_distinct(spark):
    got = spark.createDataFrame([(-1,), (0,), (123456789,)], "fp long").select(F.size(F.array_distinct(signatures(F.col("fp")))).alias("n"), F.size(signatures(F.col("fp"))).alias("m")).collect()
    assert {(r.n, r.m) for r in got} == {(67, 67)}


def test_forest_spans():
    a, b = np.array([5, 4, 3, 9, 2], np.uint64), np.array([4, 3, 2, 8, 5], np.uint64)
    x, y = forest(a, b)
    assert sorted(zip(x.tolist(), y.tolist())) == [(3, 2), (4, 2), (5, 2), (9, 8)]


def test_empty_table(no_docs):
    assert simhash_components(no_docs).count() == 0
