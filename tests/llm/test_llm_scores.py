"""Quality classifier, URL filter and token counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from quire.llm import quality, queries, token_counts, urls

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_quality_on_held_out_rows(spark):
    got = queries.op1_quality_classifier(spark, SF).toPandas().merge(queries.table(spark, SF, "labels").toPandas())
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    out = got[got.held_out]
    assert ((out.score >= 0.3) == (out.quality == 1)).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all()


def test_discriminant_is_the_plain_formula():
    r = np.random.default_rng(1)
    x = {0: r.normal(size=(200, 3)), 1: r.normal(size=(300, 3)) @ np.diag([1, 2, 3]) + 1}
    m = quality.Discriminant({k: float(len(v)) for k, v in x.items()}, {k: v.sum(0) for k, v in x.items()}, {k: v.T @ v for k, v in x.items()}, 0.0, 0.0)
    at = r.normal(size=(20, 3))
    log = {}
    for k, v in x.items():
        cov, d = np.cov(v.T, bias=True), at - v.mean(0)
        log[k] = np.log(len(v) / 500) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    assert np.allclose(m.score(at), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("held_out", F.lit(False))
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality(docs, marks).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(docs, marks.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.quality(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.quality(no_docs.withColumn("held_out", F.lit(False)), marks).count() == 0


def test_quality_ids_beyond_doubles_beside_a_null(spark):
    docs = spark.createDataFrame([(2**53 + 1, "a b", False), (None, "c", True), (2**53 + 3, None, False)], "doc_id long, text string, held_out boolean").coalesce(1)
    marks = spark.createDataFrame([(2**53 + 1, 1), (2**53 + 3, 0)], "doc_id long, quality int")
    assert {(r.doc_id, r.held_out) for r in quality.quality(docs, marks).collect()} == {(2**53 + 1, False), (None, True), (2**53 + 3, False)}


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "example.org/es/": ("", "", None), "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"), "http://example.org": ("example.org", "", None), "x://y.org/": ("y.org", "/", "org/"),
        "http://example.org?a=/es/": ("example.org", "", None), "http://badexample.org/es/": ("badexample.org", "/es/", "org/"), "http://z.com/de/": ("z.com", "/de/", "com/de/"),
        "http://z.com/fr": ("z.com", "/fr", None), "http://a.com:80/fr/": ("a.com:80", "/fr/", None), "a://b://c.org/": ("b:", "//c.org/", None), "http://É.org/\nx": ("É.org", "/\nx", "org/"),
        "http:///fr/": ("", "/fr/", None), "http://com/fr/#": ("com", "/fr/", "com/fr/"), "h" * 50_000 + "://q.net/" + "9" * 50_000: ("q.net", "/" + "9" * 50_000, None),
    }
    rows = [(k, u, 1.0, "r") for k, u in enumerate(cases)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, score double, rule string"), queries.RULES).collect()
    assert {r.url: (r.host, r.path, r.rule) for r in got} == cases
    verdicts = {f"{h}{p}": v for v, h, p in queries.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got)


def test_url_trees_learn_the_labels(spark):
    rows = [(i, f"http://s{i % 9}.{'com' if i % 3 else 'net'}/{'de' if i % 2 else 'fr'}/{i}") for i in range(600)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).where("rule is null").collect()
    assert got and all((r.verdict == "block") == ("/de/" in r.url) for r in got)


def test_url_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df, queries.RULES).collect()] == ["allow"] * 2
    assert urls.judge(df.limit(0), queries.RULES).count() == 0


def _tokenizer(vocab, byte_fallback):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_are_the_tokenizers():
    rnd = random.Random(3)
    vocab = token_counts.vocabulary(PATH)
    whole, counter = _tokenizer(vocab, True), token_counts.Counter(vocab)
    texts = ["", None, " ", "  a  b ", "▁x ▁▁", "中文 🎉 é<0x41> <s> </s> <unk>", "a\n\nb\tc", "x" * 2000]
    texts += ["".join(rnd.choice(["a", "the", " ", "▁", "é", "\n", "🎉", "ing", ".", "12"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    got = np.concatenate(list(counter.of(pa.array(texts, pa.string()))))[:, 0]
    assert got.tolist() == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_ties_as_in_the_tokenizer():
    rnd = random.Random(1)
    for _ in range(150):
        vocab = {"<unk>": 0.0, "a": -1.0, "▁": -1.0}
        for _ in range(rnd.randint(1, 10)):
            vocab["".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 4)))] = -float(rnd.randint(1, 4))
        whole, counter = _tokenizer(list(vocab.items()), False), token_counts.Counter(list(vocab.items()))
        for _ in range(8):
            t = "".join(rnd.choice("abc d") for _ in range(rnd.randint(1, 14)))
            words = (t[1:] if t[0] == " " else t).split(" ")
            assert sum(counter.count("▁" + w)[0] for w in words) == len(whole.encode(t, add_special_tokens=False).ids)


def test_token_counts_rows(spark, odd_docs, no_docs):
    whole = _tokenizer(token_counts.vocabulary(PATH), True)
    got = token_counts.token_counts(odd_docs, PATH).collect()
    want = [(r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, PATH).count() == 0
