"""JN2/WN1/AG9: sequential change-detecting upsert, set-based."""

import pytest

from quire.operators.ingest import upsert

STORED = "team string, source_url string, content string, ts int, _id string, summaries map<string,string>"
BATCH = "team string, source_url string, content string, ts int, seq long"


def py_upsert(stored, batch):
    """The reference loop: find_one, compare content, $set or insert."""
    state = {(r[0], r[1]): dict(zip(["team", "source_url", "content", "ts", "_id", "summaries"], r)) for r in stored}
    actions = []
    for r in sorted(batch, key=lambda x: x[4]):
        key = (r[0], r[1])
        doc = dict(zip(["team", "source_url", "content", "ts"], r[:4]))
        if key in state:
            if state[key]["content"] != doc["content"]:
                state[key].update(doc)
                actions.append("updated")
            else:
                actions.append("unchanged")
        else:
            state[key] = {**doc, "_id": None, "summaries": None}
            actions.append("inserted")
    return state, sorted(actions)


def run(spark, stored, batch, block):
    s = spark.createDataFrame(stored, STORED)
    b = spark.createDataFrame(batch, BATCH)
    snap, acts = upsert(s, b, keys=["team", "source_url"], seq="seq", block_size=block)
    got = {(r.team, r.source_url): r.asDict() for r in snap.collect()}
    return got, sorted(r.action for r in acts.collect())


CASES = {
    "stored A + A,B,B": ([("t", "u", "A", 0, "id1", {"default": "s"})], [("t", "u", "A", 1, 1), ("t", "u", "B", 2, 2), ("t", "u", "B", 3, 3)]),
    "fresh A,A keeps first": ([], [("t", "u", "A", 1, 1), ("t", "u", "A", 2, 2)]),
    "A,B,A": ([], [("t", "u", "A", 1, 1), ("t", "u", "B", 2, 2), ("t", "u", "A", 3, 3)]),
    "new timestamp only": ([("t", "u", "A", 0, "id1", None)], [("t", "u", "A", 9, 5)]),
    "null keys are keys": ([(None, "u", "A", 0, "id1", None)], [(None, "u", "A", 1, 1), (None, "u", "B", 2, 2), ("t", None, "C", 3, 3), ("t", None, "C", 4, 4)]),
    "null content": ([("t", "u", None, 0, "id1", None)], [("t", "u", None, 1, 1), ("t", "u", "B", 2, 2), ("t", "u", None, 3, 3)]),
    "untouched key": ([("x", "y", "Q", 0, "id9", {"a": "b"})], [("t", "u", "A", 1, 1)]),
}


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("block", [1, 2, 1 << 20])
def test_cases(spark, name, block):
    stored, batch = CASES[name]
    want_state, want_actions = py_upsert(stored, batch)
    got, actions = run(spark, stored, batch, block)
    assert actions == want_actions
    assert set(got) == set(want_state)
    for k, v in want_state.items():
        g = got[k]
        assert (g["content"], g["ts"], g["_id"]) == (v["content"], v["ts"], v["_id"]), (name, k)
        assert (g["summaries"] or None) == (v["summaries"] or None)


def test_hot_key_matches_loop_for_any_block(spark):
    contents = ["A", "A", "B", "C", "C", "C", "A", "B", "B", "D"] * 7
    batch = [("hot", "u", c, i, i) for i, c in enumerate(contents)] + [("cold", "v", "Z", 100, 100)]
    stored = [("hot", "u", "A", -1, "h", {"default": "keep"})]
    want_state, want_actions = py_upsert(stored, batch)
    for block in (1, 3, 8, 64):
        got, actions = run(spark, stored, batch, block)
        assert actions == want_actions
        assert got[("hot", "u")]["ts"] == want_state[("hot", "u")]["ts"]
        assert got[("hot", "u")]["summaries"] == {"default": "keep"}


def test_hot_key_is_spread_over_window_partitions(spark):
    from quire.operators.ingest import mark_versions

    b = spark.createDataFrame([("hot" if i % 2 else f"k{i}", "u", str(i), i, i) for i in range(400)], BATCH)
    s = spark.createDataFrame([], STORED)
    v = mark_versions(s, b, ["team", "source_url"], "seq", block_size=25)
    sizes = [r["count"] for r in v.where("team = 'hot'").groupBy("_blk").count().collect()]
    assert sum(sizes) == 200 and len(sizes) == 8 and max(sizes) <= 26


def test_idempotent(spark):
    stored = [("t", "u", "A", 0, "id1", None)]
    batch = [("t", "u", "B", 1, 1)]
    s = spark.createDataFrame(stored, STORED)
    b = spark.createDataFrame(batch, BATCH)
    snap1, _ = upsert(s, b, keys=["team", "source_url"], seq="seq")
    snap2, acts = upsert(snap1, b, keys=["team", "source_url"], seq="seq")
    assert sorted(map(tuple, snap1.collect())) == sorted(map(tuple, snap2.select(*snap1.columns).collect()))
    assert [r.action for r in acts.collect()] == ["unchanged"]



def test_refresh_on_change_clears_stale_summaries(spark):
    stored = [("t", "u", "A", 0, "id1", {"default": "old"}), ("s", "v", "X", 0, "id2", {"default": "keep"})]
    batch = [("t", "u", "B", 1, 1), ("s", "v", "X", 2, 2)]
    s = spark.createDataFrame(stored, STORED)
    b = spark.createDataFrame(batch, BATCH)
    keep, _ = upsert(s, b, keys=["team", "source_url"], seq="seq")
    fresh, _ = upsert(s, b, keys=["team", "source_url"], seq="seq", refresh_on_change=True)
    k = {r.team: r for r in keep.collect()}
    f = {r.team: r for r in fresh.collect()}
    assert k["t"].summaries == {"default": "old"} and k["t"].content == "B"
    assert f["t"].summaries is None and f["t"].content == "B" and f["t"]._id == "id1"
    assert f["s"].summaries == {"default": "keep"}  # unchanged content keeps its summaries


def test_check_unique_stored_keys(spark):
    stored = [("t", "u", "A", 0, "id1", None), ("t", "u", "B", 0, "id2", None)]
    s = spark.createDataFrame(stored, STORED)
    b = spark.createDataFrame([("t", "u", "C", 1, 1)], BATCH)
    with pytest.raises(ValueError):
        upsert(s, b, keys=["team", "source_url"], seq="seq", check_unique=True)


def test_equal_or_missing_numbers_of_a_key_are_refused(spark):
    stored = spark.createDataFrame([], STORED)
    for rows in ([("t", "u", "a", 1, 5), ("t", "u", "b", 1, 5)], [("t", "u", "a", 1, None)]):
        with pytest.raises(ValueError, match="seq is missing or not unique"):
            upsert(stored, spark.createDataFrame(rows, BATCH), ["team", "source_url"])
    upsert(stored, spark.createDataFrame([("t", "u", "a", 1, 5), ("t", "v", "b", 1, 5)], BATCH), ["team", "source_url"])
