"""JOB1: catalogue + cached files + section dumps -> assembled articles -> upsert."""

import json

from pyspark.sql import functions as F

from quire.operators.articles import sections_from_dump
from quire.plans import jobs
from quire.sources.files import TEAM_SCHEMA

STORED = "team string, source_url string, content string, timestamp timestamp, metadata map<string,string>, summaries map<string,string>"


def test_etl_cached_fetched_and_upsert(spark):
    cat = spark.createDataFrame(
        [("A", "https://x/wiki/A", "a.md", {"k": "v"}), ("B", "https://x/wiki/Club_B", "b.md", None), ("C", "https://x/wiki/C", "c.md", None)],
        TEAM_SCHEMA,
    )
    cached = spark.createDataFrame([("a.md", "")], "filename string, content string")
    dump = {"parse": {"title": "B", "sections": [
        {"level": "1", "line": "Intro", "index": "1"},
        {"level": "2", "number": "1.1", "line": "History <i>x</i>", "index": "2"},
    ]}}
    dumps = spark.createDataFrame([("B", json.dumps(dump)), ("C", "not json")], "team string, response string")
    sections = sections_from_dump(dumps, "response", ["team"])
    html = spark.createDataFrame(
        [("B", "1", "<p>Lead &amp; more<sup class=\"reference\">[1]</sup></p>"), ("B", "2", "")], "team string, index string, html string"
    )
    stored = spark.createDataFrame([], STORED)
    snap, actions = jobs.etl(spark, cat, cached, sections, html, stored)
    got = {r.team: r for r in snap.collect()}
    # cached empty file kept with ''; fetched C has no sections -> dropped; B assembled
    assert set(got) == {"A", "B"}
    assert got["A"].content == "" and got["A"].metadata == {"k": "v"}
    b = got["B"].content
    assert b.startswith("WIKIPEDIA ARTICLE: Club_B\n" + "=" * 80 + "\n\nTABLE OF CONTENTS\n" + "-" * 40 + "\n")
    assert " Intro\n  1.1 History <i>x</i>\n" in b
    assert "# Intro\n\nLead & more\n\n" + "-" * 60 + "\n" in b
    assert "## History <i>x</i>\n\n[No content available]\n\n" in b
    assert sorted(r.action for r in actions.collect()) == ["inserted", "inserted"]
    assert snap.filter(F.col("source_url") == "https://x/wiki/Club_B").count() == 1


def test_page_sections_and_article(spark):
    from quire.operators.articles import assemble_articles, sections_from_pages

    html = 'Lead &#8211; caf&eacute;<h1>T</h1><p>One two <a href="x">three</a> four<sup class="reference">[1<sup>a</sup>]</sup></p><ul><li>Five</ul>'
    html += "<script>'<h2>no</h2>'</script><H3 id=x>Small &#91;one&#93;</H3><h2></h2>Fish &amp chips"
    pages = spark.createDataFrame([(1, "https://x/wiki/Some_Page", html), (2, "u", "no heading"), (3, "u", None)], "page_id long, url string, html string")
    secs = sections_from_pages(pages).where("page_id = 1").orderBy("pos").collect()
    assert [(r.level, r.number, r.line, r.text) for r in secs] == [
        (1, None, "", "Lead – café"), (1, "1", "T", "One two three four Five"), (3, "2", "Small [one]", ""), (2, "3", "", "Fish & chips"),
    ]
    arts = {r.page_id: r.article for r in assemble_articles(sections_from_pages(pages), ["page_id"], "title").collect()}
    assert set(arts) == {1, 2}
    assert arts[1].startswith("WIKIPEDIA ARTICLE: Some_Page\n")
    assert "### Small [one]\n\n[No content available]\n\n" + "-" * 60 in arts[1]


def test_registered_page_articles_lose_no_word(spark):
    from pyspark.sql import functions as F

    from quire.functions.html import clean_html_exact
    from quire.functions.text import words
    from quire.operators.articles import sections_from_pages
    from quire.sources import tables

    p = tables.pages(spark, "/root/testdata/sf0.001", "page_id", "url", "html")
    whole = p.select("page_id", F.size(words(clean_html_exact("html"))).alias("n"))
    secs = sections_from_pages(p).groupBy("page_id").agg(F.sum(F.size(words("line")) + F.size(words("text"))).alias("m"))
    assert whole.join(secs, "page_id", "left").where("n <> coalesce(m, 0)").count() == 0


def test_sections_without_level_or_line_keep_their_text(spark):
    from quire.operators.articles import assemble_articles

    rows = [(1, "t", 0, None, "1", None, "kept"), (1, "t", 1, 2, None, "Head", None)]
    df = spark.createDataFrame(rows, "k int, title string, pos int, level int, number string, line string, text string")
    r = assemble_articles(df, ["k"], "title").first()
    assert r.n_sections == 2 and "kept" in r.article and "## Head" in r.article


def test_two_catalogue_rows_of_one_key_are_merged_in_order(spark):
    """As in a loop over the catalogue that finds one, compares and replaces: the later row counts, once."""
    rows = [("A", "https://x/wiki/A", "one.md", {"n": "1"}), ("B", "https://x/wiki/B", "b.md", None), ("A", "https://x/wiki/A", "two.md", {"n": "2"})]
    cached = spark.createDataFrame([("one.md", "one"), ("two.md", "two"), ("b.md", "bee")], "filename string, content string")
    sections = spark.createDataFrame([], "team string, pos int, level int, number string, line string, index string")
    html = spark.createDataFrame([], "team string, index string, html string")
    for order, want in ((rows, "two"), (rows[::-1], "one")):
        for stored in ([], [("A", "https://x/wiki/A", "old", None, None, {"default": "s"})]):
            snap, actions = jobs.etl(spark, spark.createDataFrame(order, TEAM_SCHEMA), cached, sections, html, spark.createDataFrame(stored, STORED))
            got = {(r.team, r.content): r.summaries for r in snap.collect()}
            assert set(got) == {("A", want), ("B", "bee")} and (not stored or got["A", want] == {"default": "s"})
            assert sorted(r.action for r in actions.collect()) == sorted(["inserted", "updated"] + (["updated"] if stored else ["inserted"]))
