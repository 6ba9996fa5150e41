"""AG2-AG5/TK3/FL5/S9: reports skip NaN/NULL; best/worst only when scores differ."""

from quire.operators.evaluate import best_worst, type_report

WIDE = "item_id string, team string, summary_type string, bert_f1 double, cosine_similarity double, combined_score double"


def test_report_skips_nan_and_null(spark):
    rows = [
        ("a", "t", "default", 0.5, 0.5, 0.5),
        ("b", "t", "default", float("nan"), None, 0.7),
        ("c", "t", None, 1.0, 1.0, 1.0),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, WIDE)
    df = df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in ("bert_f1",) else c for c in df.columns])
    rep = type_report(df).collect()
    assert len(rep) == 1 and rep[0].summary_type == "default"
    assert rep[0].bert_f1 == 0.5 and abs(rep[0].combined_score - 0.6) < 1e-12
    assert rep[0].line.startswith("default      | BERT F1: 0.5000")


def test_best_worst_ties_and_gate(spark):
    rows = [("b", "t2", "x", 0.1, 0.1, 0.9), ("a", "t1", "x", 0.1, 0.1, 0.9), ("c", "t3", "y", 0.1, 0.1, 0.2), ("d", "t4", "y", 0.1, 0.1, None)]
    got = {r.which: r for r in best_worst(spark.createDataFrame(rows, WIDE)).collect()}
    assert got["best"].item_id == "a" and got["worst"].item_id == "c"
    same = [("a", "t", "x", 0.0, 0.0, 0.5), ("b", "t", "x", 0.0, 0.0, 0.5)]
    assert best_worst(spark.createDataFrame(same, WIDE)).count() == 0


def test_term_scores_equal_the_scores_without_python(spark):
    from quire.functions.text import lower_terms, terms_from_words, words
    from quire.operators.metrics import reference_stats, row_lexical_scores, term_scores

    texts = ["", None, "  ", "a b a", "A, b! (c) -- d", "x\u00a0y z", "\u00abStra\u00dfe\u00bb \u0391\u03a3' \u0130x", "...", "a'b c-d a'b", "\u2003 a a a b "]
    df = spark.createDataFrame([(c, r) for c in texts for r in texts], "c string, r string")
    df = df.withColumn("new", term_scores(lower_terms("c"), lower_terms("r"))).withColumn("old", row_lexical_scores("c", reference_stats("r")))
    rows = df.withColumn("t", lower_terms("c")).withColumn("u", terms_from_words(words("c"))).collect()
    assert all(r.t == r.u for r in rows) and any(r.t for r in rows)
    for r in rows:
        assert [r.new[k] for k in ("precision", "recall", "cosine")] == ([r.old[k] for k in ("precision", "recall", "cosine")] if r.old else [None] * 3), (r.c, r.r)


def test_scoring_scans_no_article_once_a_word(spark):
    from quire.operators.evaluate import eval_items, score_items

    docs = spark.createDataFrame([(1, "t", "a b c", {"default": "a b"})], "_id long, team string, content string, summaries map<string,string>")
    plan = score_items(eval_items(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove(" not in plan and "aggregate(" not in plan
