"""Article assembly from a section list (SRC3, UN2, SC6-SC9, AG10).

Input: one row per section ``(article key, pos, level, number, line, text)``.
Output: one row per article with the banner, table of contents and the
section bodies in ``pos`` order.  The group is one article, so the ordered
``collect_list`` is bounded by a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import _c

# Banner and rule lines of the article layout.
TITLE_PREFIX = "WIKIPEDIA ARTICLE: "
RULE_MAJOR = "=" * 80
RULE_TOC = "-" * 40
RULE_SECTION = "-" * 60
TOC_HEADING = "TABLE OF CONTENTS"
BODY_HEADING = "FULL CONTENT"
NO_CONTENT = "[No content available]"

SECTION_DUMP_SCHEMA = T.StructType(
    [
        T.StructField(
            "parse",
            T.StructType(
                [
                    T.StructField("title", T.StringType()),
                    T.StructField(
                        "sections",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("level", T.StringType()),
                                    T.StructField("number", T.StringType()),
                                    T.StructField("line", T.StringType()),
                                    T.StructField("index", T.StringType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        )
    ]
)


def sections_from_dump(df: DataFrame, json_col: str, key_cols: list[str]) -> DataFrame:
    """SRC3 + UN2: a saved section-list response per article -> one row per section.

    A missing or unparsable response yields no sections (the article is skipped).
    """
    parsed = F.from_json(F.col(json_col), SECTION_DUMP_SCHEMA, {"mode": "PERMISSIVE"})
    return df.select(*key_cols, F.posexplode(parsed["parse"]["sections"]).alias("pos", "s")).select(
        *key_cols,
        "pos",
        F.col("s.level").try_cast("int").alias("level"),
        F.col("s.number").alias("number"),
        F.col("s.line").alias("line"),
        F.col("s.index").alias("index"),
    )


def toc_line(level: Column | str, number: Column | str, line: Column | str) -> Column:
    """SC6: two spaces per level below 1, the number ('' when absent), a space, the raw line."""
    return F.concat(F.repeat(F.lit("  "), F.coalesce(_c(level), F.lit(1)) - 1), F.coalesce(_c(number), F.lit("")), F.lit(" "), F.coalesce(_c(line), F.lit("")))


def section_block(level: Column | str, line: Column | str, text: Column | str) -> Column:
    """SC7 + SC8 + SC9: header, text (placeholder when NULL/empty), rule; lines joined by newline."""
    return F.concat(
        F.repeat(F.lit("#"), F.coalesce(_c(level), F.lit(1))),
        F.lit(" "),
        F.coalesce(_c(line), F.lit("")),
        F.lit("\n\n"),
        F.coalesce(F.nullif(_c(text), F.lit("")), F.lit(NO_CONTENT)),
        F.lit("\n\n" + RULE_SECTION + "\n"),
    )


def assemble_articles(sections: DataFrame, key_cols: list[str], title_col: str) -> DataFrame:
    """AG10: one assembled text per article (articles with no section produce no row).

    A section without level or line keeps its text: level 1, empty line.
    """
    s = sections.select(
        *key_cols,
        title_col,
        F.col("pos"),
        toc_line("level", "number", "line").alias("toc"),
        section_block("level", "line", "text").alias("block"),
    )
    agg = s.groupBy(*key_cols).agg(
        F.first(title_col).alias("_title"),
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), F.col("toc").alias("v")))).alias("_toc"),
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), F.col("block").alias("v")))).alias("_body"),
        F.count(F.lit(1)).alias("n_sections"),
    )
    header = "\n".join([RULE_MAJOR, "", TOC_HEADING, RULE_TOC]) + "\n"
    middle = "\n" + "\n".join(["", BODY_HEADING, RULE_MAJOR, ""]) + "\n"
    article = F.concat(
        F.lit(TITLE_PREFIX),
        F.col("_title"),
        F.lit("\n" + header),
        F.array_join(F.transform("_toc", lambda x: x["v"]), "\n"),
        F.lit(middle),
        F.array_join(F.transform("_body", lambda x: x["v"]), "\n"),
    )
    return agg.select(*key_cols, article.alias("article"), "n_sections")


def sections_from_documents(docs: DataFrame) -> DataFrame:
    """Section rows derived from document paragraphs (stand-in for a section dump).

    Each line of a document is one section: ``line`` is its first sentence,
    level 1 for the first line, 2 for short lines and 3 for long ones;
    ``number`` is absent at level 1; section text is the cleaned line.
    """
    from quire.functions.html import clean_html

    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "para"))
    level = F.when(F.col("pos") == 0, 1).when(F.length("para") < 200, 2).otherwise(3)
    return lines.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        "pos",
        level.alias("level"),
        F.when(F.col("pos") > 0, F.col("pos").cast("string")).alias("number"),
        F.regexp_extract("para", r"^[^.!?]*", 0).alias("line"),
        (F.col("pos") + 1).cast("string").alias("index"),
        clean_html(F.col("para")).alias("text"),
    )


# Fixed rule: a page section runs from one heading element to the next; what
# stands before the first heading is a section of its own without a heading.
HEADING = r"(?i)<(h[1-6])\b"
HEADING_PART = r"(?is)\A<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"
MARK = "\u0001"


def sections_from_pages(pages: DataFrame) -> DataFrame:
    """Section rows from page HTML, in page order; no text of the page is lost.

    Scripts, styles and comments go first, so headings inside them
    do not count.  Level and line come from the heading (level 1 and an empty
    line before the first one), the text is all that follows it, cleaned by
    the SC1-SC5 chain; the article title is the page title of the URL (PR1).
    """
    from quire.functions.html import clean_html_exact, page_title, remove_hidden

    marked = F.regexp_replace(F.translate(remove_hidden("html"), MARK, ""), HEADING, MARK + "<$1")
    parts = pages.select("page_id", page_title("url").alias("title"), F.posexplode(F.split(marked, MARK)).alias("pos", "part"))
    level = F.regexp_extract("part", HEADING_PART, 1)
    cut = parts.select(
        "page_id", "title", "pos",
        F.when(level == "", F.lit(1)).otherwise(level.try_cast("int")).alias("level"),
        F.regexp_extract("part", HEADING_PART, 2).alias("head"),
        F.regexp_replace("part", HEADING_PART, "").alias("rest"),
    )
    return cut.select(
        "page_id", "title", "pos", "level",
        F.when(F.col("pos") > 0, F.col("pos").cast("string")).alias("number"),
        clean_html_exact("head").alias("line"),
        (F.col("pos") + 1).cast("string").alias("index"),
        clean_html_exact("rest").alias("text"),
    )
