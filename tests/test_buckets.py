"""SNK2, SNK3: updates of a bucketed table replace the buckets of changed keys only."""

import os

import pytest

from quire.operators.ingest import upsert
from quire.sources import buckets

FIELDS = "team string, url string, content string, summaries map<string,string>"


def stored_files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/rows/{d}") if f.endswith(".parquet")) for d in os.listdir(f"{path}/rows") if d.startswith("bucket=")}


def rows_of(df):
    return sorted((r.team or "", r.url or "", r.content or "", sorted((r.summaries or {}).items())) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"t{i}", f"u{i % 3}", f"text {i}", {"default": f"s{i}"}) for i in range(60)] + [(None, "u", "null key", None), (None, None, "both", None)]
    path = str(tmp_path / "table")
    frame = spark.createDataFrame(rows, FIELDS)
    assert buckets.create(frame, path, ["team", "url"], 16)
    return path, frame


def test_one_changed_key_replaces_one_bucket(spark, table):
    path, frame = table
    before = stored_files(path)
    batch = spark.createDataFrame([("t7", "u1", "text 7", 1), ("t7", "u1", "new", 2), ("t8", "u2", "text 8", 1)], "team string, url string, content string, seq long")
    actions, replaced = buckets.upsert_into(spark, path, batch)
    after = stored_files(path)
    assert len(replaced) == 1 and [d for d in after if after[d] != before[d]] == [f"bucket={replaced[0]}"]
    assert sorted((r.team, r.seq, r.action) for r in actions.collect()) == [("t7", 1, "unchanged"), ("t7", 2, "updated"), ("t8", 1, "unchanged")]
    assert rows_of(buckets.read(spark, path)) == rows_of(upsert(frame, batch, ["team", "url"])[0])


def test_no_change_writes_nothing(spark, table):
    path, _ = table
    before = stored_files(path)
    batch = spark.createDataFrame([("t7", "u1", "text 7", 1), (None, "u", "null key", 1), (None, None, "both", 2)], "team string, url string, content string, seq long")
    assert buckets.upsert_into(spark, path, batch)[1] == [] and stored_files(path) == before


def test_new_and_null_keys(spark, table):
    path, frame = table
    batch = spark.createDataFrame([(None, "u", "changed", 5), ("new", None, "x", 1), ("new", "z", None, 1)], "team string, url string, content string, seq long")
    buckets.upsert_into(spark, path, batch)
    assert rows_of(buckets.read(spark, path)) == rows_of(upsert(frame, batch, ["team", "url"])[0])


def test_one_field_by_key(spark, table):
    """SNK3: only the field and the buckets of its keys change; unknown keys are left out."""
    path, _ = table
    before, old = stored_files(path), {r.team: r for r in buckets.read(spark, path).collect()}
    update = spark.createDataFrame([("t3", "u0", {"default": "s3", "recent": "r"}), ("nobody", "u0", {"a": "b"})], "team string, url string, summaries map<string,string>")
    replaced = buckets.update(spark, path, update, insert=False)
    after, got = stored_files(path), {r.team: r for r in buckets.read(spark, path).collect()}
    assert {d for d in after if after[d] != before[d]} <= {f"bucket={b}" for b in replaced} and len(replaced) <= 2
    assert got.pop("t3").summaries == {"default": "s3", "recent": "r"} and old.pop("t3").content == "text 3"
    assert got == old
    assert buckets.update(spark, path, update.limit(0)) == []


def test_created_once(spark, table):
    path, frame = table
    assert not buckets.create(frame.limit(1), path, ["team"], 4)
    assert buckets.layout(spark, path) == (["team", "url"], 16) and buckets.read(spark, path).count() == frame.count()
    with pytest.raises(ValueError):
        buckets.create(frame, path + "x", ["team"], 0)


def test_only_touched_buckets_are_read(spark, table):
    path, _ = table
    plan = buckets._stored(spark, path).where("bucket in (3, 4)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
