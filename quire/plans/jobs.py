"""Composite jobs (JOB1-JOB7) as DataFrame compositions with explicit paths.

Configuration is passed as arguments (no module globals); every job reads its
inputs from tables and writes its outputs as tables or snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.html import clean_html_exact, page_title
from quire.operators import articles, evaluate, ingest, rag, summaries
from quire.operators.observe import call_spans
from quire.operators.stored import answered
from quire.operators.vectors import build_vector_rows, missing_vectors
from quire.session import cut_lineage


def etl(
    spark: SparkSession,
    catalogue: DataFrame,
    cached: DataFrame,
    sections: DataFrame,
    section_html: DataFrame,
    stored: DataFrame,
    run_ts=None,
) -> tuple[DataFrame, DataFrame]:
    """JOB1: catalogue -> cached/fetched split -> assembled articles -> upsert.

    Catalogue rows are merged in their order (column ``position``; by default that of the frame's rows), so
    of two rows of one team and URL the later one counts.  ``cached``: ``(filename, content)``; ``sections``: ``(team, pos, level, number, line, index)``;
    ``section_html``: ``(team, index, html)``.  Returns ``(snapshot, actions)``.
    """
    if "position" not in catalogue.columns:
        catalogue = catalogue.withColumn("position", F.monotonically_increasing_id())
    # written once: the numbers are read on both sides of the split
    have, need = ingest.split_cached(cut_lineage(catalogue), cached)
    fields = ["name", "url", "filename", "metadata", "position", "content"]
    cached_rows = have.join(cached, "filename").select(*fields)
    secs = sections.join(section_html, ["team", "index"], "left").withColumn("text", clean_html_exact("html"))
    # PR1: the banner carries the page title taken from the catalogue URL
    urls = need.groupBy(F.col("name").alias("team")).agg(page_title(F.min_by("url", "position")).alias("title"))
    secs = secs.join(urls, "team")
    built = articles.assemble_articles(secs, ["team"], "title").withColumnRenamed("article", "content")
    fetched = need.join(built.withColumnRenamed("team", "name"), "name").select(*fields)
    docs = ingest.collect_documents(cached_rows, fetched).withColumnRenamed("name", "team")
    batch = ingest.parse_projection(ingest.crawled_rows(docs, run_ts), "position").withColumnRenamed("position", "seq")
    return ingest.upsert(stored, batch, keys=list(ingest.DEFAULT_KEYS), seq="seq")


def summarise(docs: DataFrame, model, chunk_tokens: int = 100_000) -> DataFrame:
    """JOB2: fill missing summaries; write the result as the next snapshot."""
    return summaries.incremental_summaries(docs, model, chunk_tokens)


def load_vectors(docs: DataFrame, vectors: DataFrame, embedder) -> DataFrame:
    """JOB3: rows to append to the vector table (no blank check, like the reference)."""
    return build_vector_rows(missing_vectors(docs, vectors), embedder)


def qa_set(questions: DataFrame, vectors: DataFrame, embedder, model, k: int = 3) -> DataFrame:
    """JOB4: RAG answers for the question list -> ``(input, expected_output)``."""
    ans = rag.answer(questions, vectors, embedder, model, k, c_id="_id")
    return cut_lineage(ans).select(F.col("question").alias("input"), F.col("answer").alias("expected_output"))


def summary_evaluation(docs: DataFrame, token_embedder=None, embedder=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOB5: items -> metric columns -> wide table, per-type report, best/worst.

    With models (both or neither) the scores come from token and text vectors, else from the words.
    """
    if (token_embedder is None) != (embedder is None):
        raise ValueError("give both embedders or neither")
    scored = evaluate.vector_scored_items(docs, token_embedder, embedder) if embedder else evaluate.score_items(evaluate.eval_items(docs))
    scored = cut_lineage(scored)
    wide = cut_lineage(evaluate.wide_results(scored, evaluate.long_scores(scored)))
    return wide, evaluate.type_report(wide), evaluate.best_worst(wide)


def qa_evaluation(qa: DataFrame, model, judges: dict) -> DataFrame:
    """JOB6: closed-book answers (question only) scored by pluggable judges.

    ``judges`` maps a score name to ``f(input_col, output_col) -> Column``.
    """
    asked = answered(qa, model, F.lit(""), F.col("input"))
    asked = cut_lineage(asked.withColumn("output", F.coalesce("_answer.value", F.lit(""))))
    return asked.select("input", "output", *[fn(F.col("input"), F.col("output")).alias(n) for n, fn in judges.items()])


def search(questions: DataFrame, vectors: DataFrame, embedder, model, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """JOB7: batch RAG answers plus their spans."""
    ans = cut_lineage(rag.answer(questions, vectors, embedder, model, k, c_id="_id"))
    spans = call_spans(ans, "rag_query_pipeline", ["query_id"], parent_id="search")
    return ans, spans
