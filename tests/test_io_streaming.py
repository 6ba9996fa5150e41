"""Sources, sinks and the streaming incremental upsert."""

import json
import os
import tempfile

from pyspark.sql import types as T

from quire.sources import files, sinks
from quire.streaming.incremental import latest_snapshot, run_incremental_upsert


def test_catalogue_and_qa_and_cached(spark):
    d = tempfile.mkdtemp(prefix="quire-io-")
    cat = os.path.join(d, "cat.json")
    with open(cat, "w") as f:
        json.dump({"teams": [{"name": "A", "url": "https://x/wiki/A_B", "filename": "a.md", "metadata": {"k": "v"}},
                             {"name": "B", "url": "https://x/wiki/B", "filename": "b.md"}]}, f)
    rows = files.catalogue(spark, cat).orderBy("name").collect()
    assert [r.name for r in rows] == ["A", "B"] and rows[0].metadata == {"k": "v"} and rows[1].metadata is None
    qa = os.path.join(d, "qa.json")
    with open(qa, "w") as f:
        json.dump([{"input": "q1", "expected_output": "é"}, {"input": "q2", "expected_output": "b"}], f, ensure_ascii=False)
    assert [tuple(r) for r in files.qa_pairs(spark, qa).collect()] == [("q1", "é"), ("q2", "b")]
    art = os.path.join(d, "articles")
    os.makedirs(art)
    with open(os.path.join(art, "a.md"), "w") as f:
        f.write("line1\nline2\n")
    got = files.cached_articles(spark, art).collect()
    assert [(r.filename, r.content) for r in got] == [("a.md", "line1\nline2\n")]
    out = os.path.join(d, "qa_out")
    sinks.write_qa_json(files.qa_pairs(spark, qa), out)
    assert spark.read.json(out).count() == 2


def test_streaming_upsert_is_incremental(spark):
    d = tempfile.mkdtemp(prefix="quire-stream-")
    src, snaps, ck = (os.path.join(d, x) for x in ("src", "snap", "ck"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("team", "source_url", "content")] + [T.StructField("seq", T.LongType())])
    spark.createDataFrame([("t", "u", "A", 1), ("t", "u", "B", 2), ("s", "v", "X", 3)], schema).write.parquet(os.path.join(src, "f1"))
    run_incremental_upsert(spark, src + "/*", schema, snaps, ck, keys=["team", "source_url"])
    first = {(r.team, r.source_url): r.content for r in latest_snapshot(spark, snaps).collect()}
    assert first == {("t", "u"): "B", ("s", "v"): "X"}
    spark.createDataFrame([("t", "u", "B", 1), ("t", "u", "C", 2)], schema).write.parquet(os.path.join(src, "f2"))
    run_incremental_upsert(spark, src + "/*", schema, snaps, ck, keys=["team", "source_url"])
    second = {(r.team, r.source_url): r.content for r in latest_snapshot(spark, snaps).collect()}
    assert second == {("t", "u"): "C", ("s", "v"): "X"}


def test_eval_set_sinks_and_experiment(spark):
    from pyspark.sql import functions as F

    from quire.operators.metrics import embedding_cosine
    from quire.operators.models import HashingEmbedder
    from quire.operators.observe import experiment_row

    d = tempfile.mkdtemp(prefix="quire-sink-")
    rows = spark.createDataFrame([("a", "x y"), ("b", "y z")], "k string, v string")
    ts = F.lit("2024-01-02 03:04:05").cast("timestamp")
    sinks.append_eval_set(rows, os.path.join(d, "sets"), "summaries_", ts)
    got = spark.read.parquet(os.path.join(d, "sets"))
    assert [r.dataset_name for r in got.select("dataset_name").distinct().collect()] == ["summaries_20240102_030405"]
    fresh = sinks.append_new_rows(spark, rows, os.path.join(d, "qa"), ["k"])
    assert fresh.count() == 2
    again = sinks.append_new_rows(spark, rows, os.path.join(d, "qa"), ["k"])
    assert again.count() == 0 and spark.read.parquet(os.path.join(d, "qa")).count() == 2
    exp = experiment_row(spark, "summary_eval", {"weights": {"bert_f1": 0.6, "cosine_sim": 0.4}}).first()
    assert exp.name == "summary_eval" and '"bert_f1": 0.6' in exp.config_json
    pairs = spark.createDataFrame([("a b c", "a b c"), ("a b", "c d")], "candidate string, reference string")
    cos = [r.cosine for r in embedding_cosine(pairs, HashingEmbedder(64)).collect()]
    assert abs(cos[0] - 1.0) < 1e-12 and -1.0 <= cos[1] < 1.0
