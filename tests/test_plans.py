"""Scale guards on the physical plans of registered queries."""

import pytest

import __spark_entry__ as E
from quire.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scans_are_pruned(spark):
    p = plan(spark, "html_clean")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p
    p = plan(spark, "word_stats")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_topk_is_batched_and_limited_before_the_shuffle(spark):
    p = plan(spark, "knn_topk")
    assert "MapInPandas" in p and "WindowGroupLimit" in p and "Partial" in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python


def test_retrieval_sends_no_text_to_python(spark, monkeypatch):
    """The search task reads ids and vectors; texts are joined to the hits."""
    from quire.operators import rag
    from quire.operators.models import HashingEmbedder, LeadChat

    plans, cut = [], rag.cut_lineage
    monkeypatch.setattr(rag, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    corpus = spark.createDataFrame([(k, f"text {k} word", [float(k % 3), 1.0] * 4) for k in range(9)], "_id long, summary_text string, embedding array<double>")
    questions = spark.createDataFrame([(1, "word text"), (2, None)], "query_id long, question string")
    got = {r.query_id: r for r in rag.answer(questions, corpus, HashingEmbedder(8), LeadChat(5), 2, c_id="_id").collect()}
    assert got[1].context.count("word") == 2 and got[2].context == ""
    nodes = [line for line in plans[0].split("\n") if "MapInPandas" in line or "FlatMapCoGroups" in line]
    assert nodes and not any("summary_text" in n for n in nodes)
