"""JOB2-JOB7 compositions run end to end on sf0.001 tables; re-running JOB2 changes nothing."""

from pyspark.sql import functions as F

from quire.functions.text import lower_terms
from quire.operators.models import HashingEmbedder, LeadChat
from quire.operators.token_match import TrigramTokens
from quire.plans import catalog as C
from quire.plans import jobs
from quire.sources import tables

SF = "/root/testdata/sf0.001"


def test_summarise_is_idempotent(spark):
    docs = C.corpus_docs(spark, SF).drop("toxic")
    once = jobs.summarise(docs, LeadChat(20), 2000).drop("summaries_changed")
    twice = jobs.summarise(once, LeadChat(20), 2000)
    assert twice.filter("summaries_changed").count() == 0


def test_vectors_search_and_eval(spark):
    docs = C.corpus_docs(spark, SF).drop("toxic")
    filled = jobs.summarise(docs, LeadChat(20), 2000).withColumn("source_url", F.col("team")).withColumn(
        "metadata", F.lit(None).cast("map<string,string>")
    ).withColumn("timestamp", F.current_timestamp())
    emb = HashingEmbedder(32)
    empty = spark.createDataFrame([], "team string, summary_type string")
    rows = jobs.load_vectors(filled, empty, emb)
    n = rows.count()
    assert n == filled.select(F.explode("summaries")).count()
    vectors = rows.withColumn("_id", F.concat_ws(":", "team", "summary_type"))
    qs = tables.questions(spark, SF).withColumnRenamed("item_id", "query_id")
    ans, spans = jobs.search(qs, vectors, emb, LeadChat(30), k=3)
    assert ans.count() == qs.count() and spans.count() == qs.count()
    qa = jobs.qa_set(qs, vectors, emb, LeadChat(30))
    judged = jobs.qa_evaluation(
        qa, LeadChat(10), {"relevance": lambda i, o: F.size(F.array_intersect(lower_terms(i), lower_terms(o))) / F.greatest(F.size(lower_terms(i)), F.lit(1))}
    )
    assert judged.filter(F.col("relevance").between(0, 1)).count() == qa.count()
    wide, report, bw = jobs.summary_evaluation(filled)
    assert report.count() == 3 and bw.count() in (0, 2)
    assert wide.filter(~F.col("bert_f1").between(0, 1)).count() == 0
    by_vectors, report, _ = jobs.summary_evaluation(filled, TrigramTokens(16), emb)
    assert by_vectors.count() == wide.count() and report.count() == 3
    # a token that occurs on the other side scores 1 in both forms, the others at least 0
    both = by_vectors.alias("v").join(wide.alias("w"), "item_id")
    assert both.filter("v.bert_precision < w.bert_precision - 1e-9 or v.bert_recall < w.bert_recall - 1e-9").count() == 0
