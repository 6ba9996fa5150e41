import zlib

from quire.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, SF).toPandas()
    docs = queries.table(spark, SF, "documents").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    out = both[both.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_families_join_close_languages(spark):
    model = langid.train(queries.table(spark, SF, "documents"))
    assert model.groups == [["de", "en"], ["es", "fr"]]


def test_odd_rows(spark, odd_docs, no_docs):
    got = langid.predict(odd_docs, langid.train(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert none == {60, 61, 62, 63, None} or none == {60, 61, 62, 63}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.train(no_docs) is None
    assert {r.lang_pred for r in langid.predict(odd_docs, None).collect()} == {"und"}
    assert langid.predict(no_docs, None).count() == 0
    one = langid.train(odd_docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(odd_docs, one).collect()} == {"en", "und"}
