import random
import re

from quire.llm import pii
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [(2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def plain(t):
    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if passes(kind, m[0])]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_on_random_and_long_texts(spark):
    rnd = random.Random(5)
    bits = ["@", "a.b@c.de", "x_y@z-1.com", ".", "..", "1.2.3.4", "256.1.1.1", "0255.001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (644) 555-7859", "+", "12", "-", " ", "é", "中", "🎉",
            "+491234567890123456", "(at)", "me (at) host.com", "555-123-4567", "1[.]2[.]3[.]4", "\n", "_", "4111.1111.1111.1111", "9" * 20 + ".1.1.1", "%"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    texts += ["", None, "a" * 100_000, "1 " * 30_000, "1." * 30_000, "+1" * 30_000, "a@" * 20_000 + "b.c", "a." * 30_000 + "@x.y", "é" * 50_000 + " q@r.com"]
    df = spark.createDataFrame([(i, t, 1, []) for i, t in enumerate(texts)], "doc_id long, text string, start int, spans array<int>").repartition(8)
    got = pii.detect(df.drop("spans"), weights=[-1.0] + [0.0] * 10).select("text", pii.joined("base_spans").alias("b"), pii.joined("spans").alias("s")).collect()
    assert len(got) == len(texts)
    assert [r.text for r in got if r.b != plain(r.text)] == []
    assert all(r.b == r.s for r in got)  # a classifier that refuses everything leaves the base spans


def test_added_spans_and_masking(spark):
    rows = [(1, "call 555-123-4567 now, or +1 (644) 555-7859"), (2, "mail me: jane.doe (at) host.com."), (3, "order 555-123-45678 of 2020-11-12 12:30"), (4, None), (None, "x@y.org x@y.org"), (None, "x@y.org x@y.org")]
    rows += [(10 + k, f"write to a{k}@b.com or phone +1 (644) 555-78{k:02d}") for k in range(40)] + [(60 + k, f"value 12 34 {k}") for k in range(40)]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined("spans").alias("s"), pii.masked(F.col("text"), "spans").alias("m")).collect()
    by = {r.doc_id: (r.s, r.m) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("phone:5:17,phone:26:43", "call [phone] now, or [phone]")
    assert by[2] == ("email:9:31", "mail me: [email].")
    assert by[3][0] == "" and by[4] == ("", None)
    assert by[None][1] == "[email] [email]"


def test_em_trusts_labelers_that_agree():
    counts = [(0, (1, 1, 1, 1), 0, 90), (0, (1, 1, 0, 1), 0, 40), (0, (0, 0, 0, 1), 0, 60), (0, (0, 0, 0, 0), 1, 70), (0, (0, 1, 1, 1), 1, 5)]
    rates, _ = pii.fit(counts)
    assert rates["f_regex"][0] > 0.8 > 0.2 > rates["f_regex"][1]
    assert rates["f_form"][0] - rates["f_form"][1] > rates["f_edges"][0] - rates["f_edges"][1]


def test_empty_table(spark, no_docs):
    assert pii.detect(no_docs).count() == 0
