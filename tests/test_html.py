"""SC1-SC5: the native regexp chain against a stdlib html.parser extraction."""

import random
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest

from quire.functions.html import clean_html, clean_html_exact, decode_references, page_title


class _Text(HTMLParser):
    """Brute-force reference: text nodes joined by a space, skipping comments,
    script/style content and sup.reference subtrees; links unwrapped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        cls = (dict(attrs).get("class") or "").split()
        if tag in ("script", "style") or (tag == "sup" and "reference" in cls):
            self.skip.append(tag)
        elif self.skip and tag == self.skip[-1]:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def reference_clean(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\s{2,}", " ", " ".join(p.parts).strip())


CASES = [
    "a<!-- c -->b",
    "a<script>x</script>b",
    'word<sup class="reference">[1]</sup>.',
    "x<sup>2</sup>y",
    'foo<a href="u">bar</a>baz',
    "fish &amp chips",
    "&amp;lt;b&amp;gt;",
    "<p>one</p>\n<p>two</p>",
    '<div title="a>b">t</div>',
    "<style>p{x:1}</style><p> a &nbsp; b </p>",
    "<script>var t=\"</p>\";</script><b>k</b>",
    "a < b and c > d",
    "&copy; 2024 &middot; x",
]


@pytest.mark.parametrize("html", CASES)
def test_clean_matches_parser(spark, html):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(clean_html("h")).first()[0] == reference_clean(html)


def test_clean_matches_parser_on_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in df.select("html", clean_html("html").alias("t")).collect():
        assert r.t == reference_clean(r.html)


def test_page_title(spark):
    df = spark.createDataFrame([("https://x/wiki/Some_Club",), ("https://x/a/wiki/b/wiki/C",), ("plain",)], "u string")
    assert [r[0] for r in df.select(page_title("u")).collect()] == ["Some_Club", "C", "plain"]


def test_nested_reference_sup_exact(spark):
    cases = [
        'a<sup class="reference">x<sup>1</sup>y</sup>b',
        'p<sup class="note reference"><sup>n</sup><sup>m</sup></sup>q <sup>2</sup>',
        'plain <b>text</b> &amp; more',
        'x &eacute;t&eacute; &#8364;5 &hearts; &notanentity; y',
        '&amp;copy; &ampx &lt;tag&gt;',
    ]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = [r[0] for r in df.select(clean_html_exact("h")).collect()]
    assert got == [reference_clean(c) for c in cases]
    assert got[0] == "a b"


def test_no_python_in_the_plans(spark):
    """Nested citations and any reference are handled by Spark expressions."""
    import __spark_entry__ as E

    for name in ("html_clean", "page_articles"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("EvalPython|InPandas|InArrow|pythonUDF", plan)
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.t for r in df.select("page_id", clean_html_exact("html").alias("t")).collect()}
    assert got == {r.page_id: reference_clean(r.html) for r in df.select("page_id", "html").collect()}


def test_every_reference(spark):
    """All names, with and without semicolon and before other text, and numbers of every kind."""
    names = [f"a &{n} b &{n}x &{n.rstrip(';')}= &{n.rstrip(';')}" for n in html5]
    numbers = [0, 1, 8, 9, 10, 11, 13, 31, 32, 38, 60, 127, 128, 129, 150, 159, 160, 8211, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 10**30]
    texts = names + [f"x&#{n};y &#{n} &#x{n:x};z &#X{n:X}" for n in numbers] + ["&", "&;", "&#;", "&#x;", "& amp;", "&&amp;&", "&#0065;", "&#x00041", "&amp;lt;", "&notit;", "&" + "a" * 40, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", decode_references("t")).collect())
    assert [(texts[i], g) for i, g in got.items() if g != unescape(texts[i])] == []


def test_generated_pages_match_the_parser(spark):
    """Random nests of tags, citations and references against the parser."""
    rnd = random.Random(11)
    opens = ['<sup class="reference">', "<sup>", "<sup class='a reference b'>", '<sup class="references">', "<SUP CLASS=reference>", '<sup id="x" title="a&gt;b" class="reference">', "<b>", '<a href="u">', "<sup data-class='reference'>"]
    words = ["one", "two ", " three", "&eacute;", "&#8211;", "&amp;lt;", "&nbsp;", "&hearts", "4 < 5", "é", "[1]", "&x;"]

    def page(depth):
        out = []
        for _ in range(rnd.randint(0, 5)):
            if depth and rnd.random() < 0.5:
                tag = rnd.choice(opens)
                out += [tag, page(depth - 1), f"</{re.match('<([a-zA-Z]+)', tag)[1]}>" if rnd.random() < 0.95 else ""]
            else:
                out.append(rnd.choice(words))
        return "".join(out)

    pages = [page(5) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    got = dict(df.select("i", clean_html_exact("h")).collect())
    assert [(pages[i], g, reference_clean(pages[i])) for i, g in got.items() if g != reference_clean(pages[i])][:3] == []
