"""Conversation trie against a plain build of every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quire.llm.conversations import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - (abs(c) % 5 if c > 0 else -(abs(c) % 5)), [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(full.items()):
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def conversations(seed, n, longest):
    """Few different texts, so that prefixes meet; some conversations are very long."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * n), n):
        for t in range(rnd.choice([1, 2, 3, 9, 12, longest])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["hello", "yes", "é"]) if rnd.random() < 0.3 else "same"))
    rnd.shuffle(rows)
    return rows


FIELDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("band", "longest"), [(8, 20), (2, 40), (3, 9)])
def test_matches_plain_build(spark, band, longest):
    rows = conversations(band, 60, longest)
    got = prefix_trie(spark.createDataFrame(rows, FIELDS), band=band)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_odd_rows(spark):
    long = "word " * 20_000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (1, None, "system", "first"), (2, 5, "user", ""), (2, 6, "", "x"), (None, 0, "user", "a"), (None, None, None, None)]
    rows += [(3, t, "user", long) for t in range(12)] + [(0, t, "user", long) for t in range(12)] + [(4, 1, "user", None), (-7, 0, "user", "a"), (-5, 0, "user", "b"), (2**53 + 1, 0, "user", "a")]
    rows += [(50, 0, "u", x) for x in "edcba"] * 2 + [(8, 0, "1:", "a"), (9, 0, "1", ":a")]
    frame = spark.createDataFrame(rows, FIELDS).selectExpr("*", "conv_id AS node", "turn AS depth", "'x' AS path", "0 AS a", "0 AS bytes", "1 AS row")
    assert sorted(map(tuple, prefix_trie(frame).collect())) == plain(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows: its turns are ranked across ranges, its prefixes across blocks."""
    rows = [(10, t, "user", f"t{t % 7}") for t in range(3000)] + [(11, t, "user", f"t{t % 7}") for t in range(700)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie(spark.createDataFrame(rows, FIELDS)).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in (10, 11)}
    assert len(got) == 3001 and all((r.n_convs == 2) == (r.depth <= 700) and r.n_leaves == 1 for r in got.values())
    assert got[10, 0].saved_tokens == 2 * 700 and got[10, 700].saved_tokens == 2 and h[11] < 700
    assert got[10, 700].ends_sha256 == hashlib.sha256(b"11").hexdigest() and got[10, 3000].ends_sha256 == hashlib.sha256(b"10").hexdigest()


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], FIELDS)).count() == 0
