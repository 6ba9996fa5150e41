"""The pipeline's stages take effect, keep the columns, and take empty and odd documents."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quire.llm import queries

SF = "/root/testdata/sf0.01"


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packed"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.fixture(scope="module")
def small(spark):
    item = queries.table(spark, SF, "benchmark").where("length(text) > 150").orderBy("item_id").first().text
    body = queries.table(spark, SF, "documents").where("lang = 'en' and n_chars between 400 and 1500").orderBy("doc_id").limit(120).collect()
    rows = [(1000 + k, r.text, r.lang, "s", r.n_chars, "extra") for k, r in enumerate(body)]
    words = body[0].text.split()
    words[len(words) // 2] = "edited"
    rows += [(1, None, "en", "s", 0, "x"), (2, "... 123", "en", "s", 7, "x"), (5000, " ".join(words), "en", "s", 9, "x"), (5001, body[0].text, "en", "s", 9, "x"), (5002, "This is the " + item, "en", "s", 9, "x")]
    rows += [(5003, "The that was a note of anon: jo.do@mail.example.org and the 10.0.0.1 there", "en", "s", 74, "x"), (None, "the of and to in the that was", "en", "s", 9, "x")]
    rows = [(*r, 0.5, [1], "zz", 3) for r in rows]
    return spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double, spans array<int>, lang_pred string, number long")


def test_stages_in_order(spark, small):
    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == small.columns and docs.dtypes == small.dtypes
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {1, 2} & seen["language_id"] == set() and 5000 in seen["language_id"] and None in seen["language_id"]
    assert {5000, 5001} & seen["near_duplicates"] == set() and 1000 in seen["near_duplicates"] and None in seen["near_duplicates"]
    assert 5002 not in seen["decontamination"] and 5003 in seen["decontamination"]
    row = docs.where("doc_id = 5003").first()
    assert (row.score, row.spans, row.lang_pred, row.number, row.component_id) == (0.5, [1], "zz", 3, "x")
    assert docs.where("doc_id = 1000").count() == 1
    assert row.text == "The that was a note of anon: [email] and the [ip] there" and row.n_chars == len(row.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen["personal_data"]


def test_stages_on_no_documents(spark, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, small.limit(0), SF).count() == 0


UNLEARNED = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "qwrt zxcv hjkl pqwz xkcd vvbn mzxq jjkw qqzx wvkj xzqp fghj kqzx vwxq zzkj",
]


@pytest.mark.parametrize("langs", [("en",), ("de", "en", "es", "fr")])
def test_unlearned_languages_go_and_clean_documents_stay(spark, langs):
    learned = queries.table(spark, SF, "documents").where(F.col("lang").isin(*langs) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    docs = learned.unionByName(spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(UNLEARNED)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).select("doc_id").collect()}
    assert not {d for d in kept if d < 0}
    clean = {r.doc_id for r in learned.select("doc_id").collect()}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_contaminated_rows_go_by_id_and_text(spark):
    item = queries.table(spark, SF, "benchmark").where("length(text) > 150").orderBy("item_id").first().text
    rows = [(None, "so " + item), (None, "a clean text without an id"), (7, item), (7, "a clean text of the same id"), (7, None), (8, "clean")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, `odd.name` int")
    got = corpus_pipeline.decontamination(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert {r["odd.name"] for r in got.collect()} == {1, 3, 4, 5}
