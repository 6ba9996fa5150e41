"""ML1, ML2: one call a distinct prompt over runs and retries; bounded back-off; recorded times."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import stored
from quire.operators.models import remote_chat, remote_embedder


def counting(log, fail=lambda user, n: False):
    """A client that notes each call in a file (workers are other processes) and fails as told."""

    def call(system, user, max_tokens):
        with open(log, "a") as f:
            f.write(f"{user}\n")
        with open(log) as f:
            n = f.read().split("\n").count(user)
        if fail(user, n):
            raise RuntimeError("service unavailable")
        return None if user is None else user.upper()

    return call


def calls_of(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


@pytest.mark.parametrize("waves", [1, 3])
def test_one_call_a_prompt_over_two_runs_and_a_failed_job(spark, tmp_path, waves):
    log, path = str(tmp_path / "log"), str(tmp_path / "store")
    model = stored.StoredChat(remote_chat(counting(log)), "m", path, waves)
    calls = spark.createDataFrame([(i, f"p{i % 4}") for i in range(40)], "id long, user string").repartition(5)
    out = stored.answered(calls, model, F.lit(""), "user")
    assert calls_of(log) == ["p0", "p1", "p2", "p3"]
    broken = F.udf(lambda v: 1 / 0, "int")
    with pytest.raises(Exception):  # a job after the calls fails; what follows reads the store
        out.withColumn("x", broken("user")).collect()
    assert {(r.user, r._answer.value) for r in out.collect()} == {(f"p{i}", f"P{i}") for i in range(4)}
    more = calls.unionByName(spark.createDataFrame([(99, "p9")], calls.schema))
    again = stored.answered(more, stored.StoredChat(remote_chat(counting(log)), "m", path, waves), F.lit(""), "user")
    assert again.count() == 41 and calls_of(log) == ["p0", "p1", "p2", "p3", "p9"]
    other = stored.answered(calls.limit(1), stored.StoredChat(remote_chat(counting(log)), "other", path), F.lit(""), "user")
    assert other.count() == 1 and len(calls_of(log)) == 6  # another model's answers are its own


def test_failed_calls_are_tried_again_then_reported_then_asked_again(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "store")
    fail = lambda user, n: user == "down" and n <= 4 or user == "flaky" and n <= 2
    model = lambda: stored.StoredChat(remote_chat(counting(log, fail), attempts=3, wait=0.01), "m", path)
    calls = spark.createDataFrame([("down",), ("flaky",), ("fine",)], "user string").coalesce(1)
    got = {r.user: r._answer for r in stored.answered(calls, model(), F.lit("s"), "user").collect()}
    assert got["down"].value is None and got["down"].error == "service unavailable"
    assert got["flaky"].value == "FLAKY" and got["fine"].value == "FINE" and got["flaky"].error is None
    assert calls_of(log) == ["down"] * 3 + ["fine"] + ["flaky"] * 3
    got = {r.user: r._answer for r in stored.answered(calls, model(), F.lit("s"), "user").collect()}
    assert got["down"].value == "DOWN" and calls_of(log).count("down") == 5 and len(calls_of(log)) == 9
    spans = stored.call_records(spark, path, "chat", parent_id="fill").collect()
    assert len(spans) == 4 and len({s.span_id for s in spans}) == 4 and all(s.start <= s.end and s.parent_id == "fill" for s in spans)
    assert sorted((s.status, s.attempts) for s in spans) == [("error", 3), ("ok", 1), ("ok", 2), ("ok", 3)]


def test_waits_double_up_to_a_bound():
    from quire.operators.models import _tried

    def down():
        raise ValueError

    began = time.time()
    value, error, attempts, started, ended = _tried(down, 4, 0.05, 0.1)
    assert (value, error, attempts) == (None, "ValueError", 4) and 0.24 <= time.time() - began < 1.5 and started < ended


def test_a_failing_text_does_not_fail_its_batch(spark, tmp_path):
    def client(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    plain = remote_embedder(client, attempts=2, wait=0.01)
    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "abc")], "id long, t string").coalesce(1)
    got = {r.id: r.v for r in rows.select("id", plain.embed_result("t").alias("v")).collect()}
    assert got[1].value == [3.0, 1.0] and got[3].value == [0.0, 1.0] and got[2].value is None and got[2].error == "refused"
    kept = stored.StoredEmbedder(plain, "e", str(tmp_path / "vectors"))
    out = {r.id: r.embedding for r in stored.embedded(rows, kept, "t").collect()}
    assert out == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0], 4: [3.0, 1.0]}
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 3  # distinct texts


def test_prompts_are_told_apart(spark, tmp_path):
    model = stored.StoredChat(remote_chat(lambda s, u, n: f"{s}|{u}|{n}"), "m", str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("", "c"), ("a", None)], "s string, u string")
    got = stored.answered(rows, model, "s", "u", 7).collect()
    assert len(got) == 5 and len({r._answer.value for r in got}) == 5
