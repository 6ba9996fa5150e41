"""Summary evaluation and reports (UN4, FL2, FL3, FL5, SC10, PR6, PR7, JN7, SO2, AG2-AG5, UN6, TK3, OB3).

Items are (document, summary type) pairs with a non-blank summary.  Results
are joined back to items by key (not by list position), so a missing score
row becomes NULL scores instead of shifting labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import fmt4, lower_terms, non_blank, strip_ws, word_count
from quire.functions.vectors import cosine
from quire.operators.metrics import combined, f1, term_scores
from quire.operators.summaries import VARIANT_NAMES, variant_lookup
from quire.operators.token_match import token_match

SCORE_NAMES = ["BERTPrecision", "BERTRecall", "BERTF1", "CosineSimilarity", "CombinedScore"]
WIDE_NAMES = {
    "BERTPrecision": "bert_precision",
    "BERTRecall": "bert_recall",
    "BERTF1": "bert_f1",
    "CosineSimilarity": "cosine_similarity",
    "CombinedScore": "combined_score",
}


def eval_items(docs: DataFrame, summary_types: list[str] | None = None) -> DataFrame:
    """UN4 + FL2 + FL3 + SC10: one row per (document, summary type) with a non-blank summary.

    ``docs``: ``_id, team, content, summaries``.  Only the fixed summary types
    are read (other map keys are ignored, unlike the vector load).  The
    article's terms (``_ref``) and length are made once per document, before
    the per-type explode, so items never carry the article text.  Stripping does not
    change a text's words, so the reference is the content as stored.
    """
    types = summary_types or VARIANT_NAMES
    d = docs.filter(non_blank("content")).select(
        "_id",
        "team",
        "summaries",
        word_count("content").alias("_n"),
        lower_terms("content").alias("_ref"),
    )
    d = d.select("*", F.posexplode(F.array(*[F.lit(t) for t in types])).alias("_tpos", "summary_type"))
    d = d.withColumn("summary", strip_ws(F.coalesce(variant_lookup("summaries", "summary_type"), F.lit(""))))
    d = d.filter(non_blank("summary"))
    return d.select(
        F.concat_ws(":", F.col("_id").cast("string"), "summary_type").alias("item_id"),
        "_id",
        "team",
        "summary_type",
        "summary",
        F.col("_n").alias("article_length"),
        word_count("summary").alias("summary_length"),
        "_ref",
    )


def score_items(items: DataFrame, bert_weight: float = 0.6, cosine_weight: float = 0.4) -> DataFrame:
    """PR6 + ML7-ML9 per row: candidate = summary, reference = article (no shuffle).

    Returns the item's labels and lengths with ``precision, recall, f1, cosine,
    combined`` and ``error`` (FL6: blank input gives NULL scores; items only
    exist for non-blank articles, so the summary is the side to check).
    """
    s = items.withColumn("_s", term_scores(lower_terms("summary"), "_ref"))
    blank = ~non_blank("summary")
    out = s.select(
        "item_id", "_id", "team", "summary_type", "summary_length", "article_length",
        *[F.when(~blank, F.col("_s")[c]).alias(c) for c in ("precision", "recall", "cosine")],
        F.when(blank, F.lit("Input texts cannot be empty or whitespace.")).alias("error"),
    )
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.withColumn("combined", combined("f1", "cosine", bert_weight, cosine_weight))


def vector_scored_items(
    docs: DataFrame, token_embedder, embedder, bert_weight: float = 0.6, cosine_weight: float = 0.4, summary_types: list[str] | None = None
) -> DataFrame:
    """:func:`score_items` with models: token vectors for ``precision, recall, f1``, text vectors for ``cosine``.

    The same items and columns as :func:`eval_items` and :func:`score_items`.  A document's summaries are
    scored in its row, so its article is embedded once for them and nothing is shuffled.  A summary or
    article without tokens, or that the embedder gives no vector, has NULL scores.
    """
    types = summary_types or VARIANT_NAMES
    d = docs.filter(non_blank("content")).select("_id", "team", "content", *[strip_ws(variant_lookup("summaries", F.lit(t))).alias(f"_s{i}") for i, t in enumerate(types)])
    # the models' vectors are columns of their own: they cannot sit in a lambda
    d = d.withColumns({"_v": embedder.embed("content"), **{f"_v{i}": embedder.embed(f"_s{i}") for i in range(len(types))}})
    items = [
        F.when(
            non_blank(f"_s{i}"),
            F.struct(
                F.lit(t).alias("summary_type"),
                word_count(f"_s{i}").alias("summary_length"),
                cosine("_v", f"_v{i}").alias("cosine"),
                token_embedder.tokens(f"_s{i}").alias("tokens"),
            ),
        )
        for i, t in enumerate(types)
    ]
    d = d.select(
        "_id", "team", word_count("content").alias("article_length"), "content",
        F.filter(F.array(*items), lambda x: x.isNotNull()).alias("_items"),
    ).filter(F.size("_items") > 0)
    d = d.withColumn("_ref", token_embedder.tokens("content"))
    s = token_match(d, token_embedder, "_ref", "_items", ["_id", "team", "article_length"])
    out = s.select(
        F.concat_ws(":", F.col("_id").cast("string"), "summary_type").alias("item_id"),
        "_id", "team", "summary_type", "summary_length", "article_length", "precision", "recall", "cosine",
        F.lit(None).cast("string").alias("error"),
        f1(F.col("precision"), F.col("recall")).alias("f1"),
    )
    return out.withColumn("combined", combined("f1", "cosine", bert_weight, cosine_weight))


def long_scores(scored: DataFrame) -> DataFrame:
    """UN6: wide scores -> ``(item_id, ordinal, name, value)`` rows (the evaluator's shape)."""
    # the order in which the metrics emit their results
    emitted = [
        ("BERTRecall", "recall"),
        ("BERTPrecision", "precision"),
        ("BERTF1", "f1"),
        ("CosineSimilarity", "cosine"),
        ("CombinedScore", "combined"),
    ]
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.col(c).alias("value"))
            for i, (n, c) in enumerate(emitted)
        ]
    )
    return scored.select("item_id", F.inline(entries)).filter(F.col("value").isNotNull())


def wide_results(items: DataFrame, scores_long: DataFrame) -> DataFrame:
    """AG5 + JN7 + SO2 + PR7 + SC18: one row per item, last value per name wins.

    ``items`` carries the item labels and lengths (a scored table will do).  An item
    without scores keeps its row with NULL scores; without a team or summary
    type it is labelled by its id (``team_<id>``, ``type_<id>``), which needs no global numbering.
    """
    wide = (
        scores_long.groupBy("item_id")
        .pivot("name", SCORE_NAMES)
        .agg(F.max_by("value", "ordinal"))
    )
    light = items.select("item_id", "team", "summary_type", "summary_length", "article_length")
    label = lambda c, prefix: F.coalesce(c, F.concat(F.lit(prefix), "item_id")).alias(c)
    light = light.select("item_id", label("team", "team_"), label("summary_type", "type_"), "summary_length", "article_length")
    out = light.join(wide, "item_id", "left")
    return out.select(
        "item_id",
        "team",
        "summary_type",
        *[F.col(n).cast("string").try_cast("double").alias(WIDE_NAMES[n]) for n in SCORE_NAMES],
        F.coalesce("summary_length", F.lit(0)).cast("bigint").alias("summary_length"),
        F.coalesce("article_length", F.lit(0)).cast("bigint").alias("article_length"),
    ).select(
        "item_id",
        "team",
        "summary_type",
        *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in WIDE_NAMES.values()],
        "summary_length",
        "article_length",
    )


def has_scores(wide: DataFrame) -> bool:
    """AG4: false when the table is empty or every combined score is NULL."""
    return wide.filter(F.col("combined_score").isNotNull()).limit(1).count() > 0


def report_line() -> Column:
    """SC19: one summary type's means as a line of the report."""
    return F.format_string(
        "%-12s | BERT F1: %s | Cosine: %s | Combined: %s",
        F.col("summary_type"), fmt4("bert_f1"), fmt4("cosine_similarity"), fmt4("combined_score"),
    )


def type_report(wide: DataFrame) -> DataFrame:
    """AG2 + SC19: mean F1 / cosine / combined per summary type (NaN and NULL skipped)."""
    return (
        wide.filter(F.col("summary_type").isNotNull())
        .groupBy("summary_type")
        .agg(
            F.avg("bert_f1").alias("bert_f1"),
            F.avg("cosine_similarity").alias("cosine_similarity"),
            F.avg("combined_score").alias("combined_score"),
        )
        .withColumn("line", report_line())
        .orderBy("summary_type")
    )


def best_worst(wide: DataFrame, order_col: str = "item_id") -> DataFrame:
    """AG3 + FL5 + TK3: best and worst row by combined score, only when scores differ.

    Ties go to the first row in ``order_col`` order.  Both ends are global
    top-1 selections (``max_by``/``min_by`` on a struct), aggregated map-side.
    """
    valid = wide.filter(F.col("combined_score").isNotNull())
    row = F.struct("team", "summary_type", "combined_score", order_col)
    agg = valid.agg(
        # nunique() > 1  <=>  min < max: no distinct aggregation needed
        (F.min("combined_score") < F.max("combined_score")).alias("varies"),
        F.min_by(row, F.struct(-F.col("combined_score"), F.col(order_col))).alias("best"),
        F.min_by(row, F.struct(F.col("combined_score"), F.col(order_col))).alias("worst"),
    )
    return best_worst_rows(agg, order_col)


def best_worst_rows(ends: DataFrame, order_col: str = "item_id") -> DataFrame:
    """The rows of :func:`best_worst` from its one row ``varies, best, worst``."""
    rows = ends.filter(F.col("varies")).select(
        F.inline(F.array(
            F.struct(F.lit("best").alias("which"), F.col("best").alias("r")),
            F.struct(F.lit("worst").alias("which"), F.col("worst").alias("r")),
        ))
    )
    return rows.select(
        "which",
        F.col("r.team").alias("team"),
        F.col("r.summary_type").alias("summary_type"),
        F.col("r.combined_score").alias("combined_score"),
        F.col(f"r.{order_col}").alias(order_col),
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """TK5: the first rows of a result."""
    return df.limit(n)

