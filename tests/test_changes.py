"""2.12: stateful change detection over drops of files, replays included; state without texts."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.ingest import upsert
from quire.sources import buckets
from quire.streaming import changes

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("team", "url", "content")] + [T.StructField("seq", T.LongType())])
KEYS = ["team", "url"]
DROPS = [
    [("t", "u", "A", 1), ("t", "u", "B", 2), ("t", "u", "B", 3), ("s", "v", "a secret text", 1), (None, "w", None, 1)],
    [("t", "u", "B", 4), ("t", "u", "C", 5), ("s", "v", "a secret text", 2), (None, "w", "x", 2), ("n", None, "", 1)],
    [("t", "u", "A", 6), ("s", "v", "Z", 3), ("s", "v", "a secret text", 4), ("n", None, None, 2)],
]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("changes"))
    src, table, ck = (os.path.join(root, x) for x in ("src", "table", "ck"))
    for k, rows in enumerate([*DROPS, DROPS[1]]):  # the last drop repeats the second
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/drop{k}")
        changes.run_change_stream(spark, f"{src}/*", SCHEMA, table, ck, KEYS, n_buckets=8)
    return table, ck


def test_drops_and_a_replay_equal_the_batch_upsert(spark, run):
    empty = spark.createDataFrame([], "team string, url string, content string")
    all_rows = spark.createDataFrame([r for d in DROPS for r in d], SCHEMA)
    want = upsert(empty, all_rows, KEYS)[0]
    key = lambda df: sorted((r.team or "", r.url or "", str(r.content)) for r in df.select("team", "url", "content").collect())
    assert key(buckets.read(spark, run[0])) == key(want)


def test_state_holds_no_text(run):
    held = [f for f in glob.glob(f"{run[1]}/state/**/*", recursive=True) if os.path.isfile(f)]
    assert held and not any(b"a secret text" in open(f, "rb").read() for f in held)
    assert changes.STATE.names == ["digest", "last"]


def test_only_changed_versions_are_emitted(spark, tmp_path):
    src = str(tmp_path / "src")
    for k, rows in enumerate([*DROPS, DROPS[0]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/drop{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    changes.changed_versions(stream, KEYS).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.team or "", r.seq, r.action) for r in spark.read.parquet(out).collect())
    assert got == [("", 1, "inserted"), ("", 2, "updated"), ("n", 1, "inserted"), ("n", 2, "updated"), ("s", 1, "inserted"), ("s", 3, "updated"), ("s", 4, "updated"), ("t", 1, "inserted"), ("t", 2, "updated"), ("t", 5, "updated"), ("t", 6, "updated")]


def test_anti_joins_as_streams(spark, tmp_path):
    fields = "_id long, team string, source_url string, metadata map<string,string>, timestamp timestamp, content string, summaries map<string,string>"
    src = str(tmp_path / "docs")
    rows = [(1, "t", "u", None, None, "long text", {"default": "x", "recent": " "}), (2, "s", "v", None, None, "other", None), (3, "b", "v", None, None, "  ", None)]
    stored = spark.createDataFrame([("t", "default")], "team string, summary_type string")
    outs = {"vectors": lambda d: changes.new_vector_rows(d, stored).select("team", "summary_type"), "pairs": lambda d: changes.new_missing_pairs(d).select("_id", "variant")}
    for k in range(2):  # the second drop repeats the first and adds a summary
        more = [(4, "t", "u", None, None, "long text", {"achievements": "y"})] if k else []
        spark.createDataFrame(rows + more, fields).coalesce(1).write.parquet(f"{src}/d{k}")
        for name, of in outs.items():
            stream = spark.readStream.schema(spark.createDataFrame([], fields).schema).parquet(f"{src}/*")
            of(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination()
    got = {name: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()) for name in outs}
    assert got["vectors"] == [("t", "achievements"), ("t", "recent")]
    variants = ["achievements", "default", "recent"]
    assert got["pairs"] == sorted([(1, v) for v in variants if v != "default"] + [(2, v) for v in variants] + [(4, v) for v in variants if v != "achievements"])
