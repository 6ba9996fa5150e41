"""ML1/ML2/SC25 plug points: remote-style batch functions, errors become columns."""

from pyspark.sql import functions as F

from quire.operators.models import HashingEmbedder, LeadChat, remote_chat, remote_embedder


def test_remote_chat_errors_are_rows(spark):
    def flaky(system, user, max_tokens):  # defined here so it is pickled by value
        if "boom" in user:
            raise RuntimeError("service unavailable")
        return user.upper()[:max_tokens]

    df = spark.createDataFrame([("hello",), ("boom now",)], "u string")
    model = remote_chat(flaky, max_tokens=3)
    got = {r.u: r.res for r in df.select("u", model.complete(F.lit("sys"), F.col("u")).alias("res")).collect()}
    assert got["hello"].value == "HEL" and got["hello"].error is None
    assert got["boom now"].value is None and "unavailable" in got["boom now"].error


def test_remote_embedder_and_stand_ins(spark):
    emb = remote_embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [list(r[0]) for r in df.select(emb.embed("t")).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    h = HashingEmbedder(16)
    v = df.select(h.embed("t").alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1.0) < 1e-12 and v[1].v is None
    lead = df.select(LeadChat(2).complete(F.lit(""), F.lit("one  two\tthree"))["value"]).first()[0]
    assert lead == "one two"
