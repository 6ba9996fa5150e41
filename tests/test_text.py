"""S1-S3, S10, SC10, SC11, SC13-SC19: whitespace-aware text functions vs Python."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions import text as tx

SAMPLES = [
    "",
    "   ",
    "\t a \n",
    "a b",
    "x\u001cy\u001fz",
    "p q　r",
    " a b ",
    "one  two\tthree\nfour",
    "\u0085lead and trail ",
    "plain",
]


def test_split_strip_match_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    rows = df.select(
        "i",
        tx.word_count("s").alias("n"),
        tx.rough_tokens("s").alias("tok"),
        tx.strip_ws("s").alias("st"),
        tx.words("s").alias("w"),
        tx.is_blank("s").alias("blank"),
    ).collect()
    for r in rows:
        s = SAMPLES[r.i]
        assert r.n == len(s.split()), s
        assert r.tok == int(len(s.split()) / 0.75)
        assert r.st == s.strip(), repr(s)
        assert list(r.w) == s.split()
        assert r.blank == (not s.strip())


def test_rough_tokens_equals_python_on_range(spark):
    df = spark.range(0, 3000).select(F.col("id"), F.array_join(F.array_repeat(F.lit("w"), F.col("id").cast("int")), " ").alias("s"))
    for r in df.select("id", tx.rough_tokens("s").alias("t")).collect():
        assert r.t == int(r.id / 0.75)


def test_collapse_keeps_single_newline(spark):
    df = spark.createDataFrame([("a\nb  c\t\td",)], "s string")
    assert df.select(tx.collapse_ws("s")).first()[0] == "a\nb c d"


def test_fill_template_reads_placeholders_once(spark):
    tpl = "Team {team}: {content} / {{literal}}"
    df = spark.createDataFrame([("{content}", "x {team} y")], "team string, content string")
    got = df.select(tx.fill_template(tpl, team=F.col("team"), content=F.col("content"))).first()[0]
    assert got == tpl.format(team="{content}", content="x {team} y")


def test_iso_and_stamp(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 5, 6, 7, 8, 9),), (dt.datetime(2024, 5, 6, 7, 8, 9, 120000),)], "ts timestamp"
    )
    got = [r[0] for r in df.select(tx.iso_timestamp("ts")).collect()]
    assert got == ["2024-05-06T07:08:09+00:00", "2024-05-06T07:08:09.120000+00:00"]
    assert df.select(tx.stamp_name("run_", "ts")).first()[0] == "run_20240506_070809"


def test_to_number_and_fmt(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(tx.to_number("v")).collect()] == [1.5, None, None, None]
    assert spark.range(1).select(tx.fmt4(F.lit(0.123456))).first()[0] == "0.1235"


def test_random_whitespace_parity(spark):
    import random

    import regex

    ws = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    other = list("abcXYZéß.,;!?-'\"()[]{}@#$%^&*+=<>/\\|~`") + ["é", "中", "—", "¿"]
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ws if rnd.random() < 0.4 else other) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select(
        "i", tx.words("s").alias("w"), tx.strip_ws("s").alias("st"), tx.word_count("s").alias("n"), tx.lower_terms("s").alias("t")
    ).collect()
    for r in rows:
        s = texts[r.i]
        assert list(r.w) == s.split(), repr(s)
        assert r.st == s.strip(), repr(s)
        assert r.n == len(s.split())
        want = [x for x in (regex.sub(r"\A[\p{P}\p{S}]+|[\p{P}\p{S}]+\Z", "", w).lower() for w in s.split()) if x]
        assert list(r.t) == want, repr(s)
