"""Registered queries over the corpus tables and their DuckDB oracles.

Every query reads whole tables (``documents pages embeddings benchmark labels
conversations``) and returns a DataFrame; computed columns carry the same
names as in the oracle SQL.  Scores are rounded to 6 decimals on both sides.

Derived inputs (fixed rules, shared by the Spark and SQL sides):

* corpus documents: ``_id = doc_id``, ``team = 'doc-' || doc_id``,
  ``content = text``;
* stored summaries: documents with a ``labels`` row have a summaries map:
  ``default`` = first 12 words when quality = 1, ``recent`` = a blank value
  when toxic = 1, and an unknown ``legacy`` key = first 5 words when
  quality = 0; other documents have no map;
* stored summary vectors: summaries of labelled documents with toxic = 0;
* upsert: key ``(lang, source)``, stored row = lowest ``doc_id`` per key,
  batch = all other rows, ``seq = doc_id``;
* stand-in models: chat answers with 39 words taken evenly from the whole user
  message and a digest of it, and fails or stays empty for one digest in 16
  each; embedder = 64-bucket hashed term frequency.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.html import clean_html_exact, page_title
from quire.functions.vectors import contract_violation, norm
from quire.operators import articles, chunking, evaluate, ingest, rag, summaries
from quire.operators.knn import exact_topk
from quire.operators.metrics import embedding_cosine, greedy_match
from quire.operators.models import HashingEmbedder, SpreadChat
from quire.operators.stored import StoredChat, answered
from quire.operators.token_match import TrigramTokens
from quire.operators.vectors import VECTOR_KEYS, missing_vectors as missing_vector_rows
from quire.session import cut_lineage, ensure_checkpoint_dir
from quire.sources import tables

# Fixed parameters of the registered queries.
TOP_K = 3
CHUNK_WORDS_TOKENS = 300
SUMMARY_CHUNK_TOKENS = 2_000
ANSWER_WORDS = 39
EMBED_DIM = 64
TOKEN_DIM = 32
VECTOR_DIM = 64
NUM_CANDIDATES = 50
BUCKETS = 16
DROPS = 3
IVF_ROUNDS = 2
IVF_SHARE = 0.75
N_LABELS = 10

R6 = 6


def _r(c):
    return F.round(c, R6)


# --------------------------------------------------------------------------- derived inputs


def corpus_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their stored summaries map (see module docstring)."""
    d = tables.documents(spark, sf, "doc_id", "text")
    lab = tables.read_table(spark, sf, "labels", spread_rows=False)
    d = d.join(lab, "doc_id", "left")
    def stored_map(w):
        lead = lambda n: F.array_join(F.slice(w, 1, n), " ")
        entries = F.filter(
            F.array(
                F.when(F.col("quality") == 1, F.struct(F.lit("default").alias("k"), lead(12).alias("v"))),
                F.when(F.col("toxic") == 1, F.struct(F.lit("recent").alias("k"), F.lit("  ").alias("v"))),
                F.when(F.col("quality") == 0, F.struct(F.lit("legacy").alias("k"), lead(5).alias("v"))),
            ),
            lambda x: x.isNotNull(),
        )
        return F.map_from_entries(entries)

    labelled = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return d.select(
        F.col("doc_id").alias("_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("team"),
        F.col("text").alias("content"),
        # the word array is bound once per labelled document
        F.when(labelled, tx.let(tx.first_words("text", 12), stored_map)).alias("summaries"),
        F.col("toxic"),
    )


def filled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """JOB2: corpus documents after incremental summarisation with the stand-in model."""
    return summaries.incremental_summaries(corpus_docs(spark, sf), SpreadChat(ANSWER_WORDS), SUMMARY_CHUNK_TOKENS)


def q_summary_errors(spark, sf):
    """ML3 + FL4 + SC25: every model answer of the fill, with its error and failed chunks."""
    d = corpus_docs(spark, sf)
    pairs = summaries.missing_pairs(d).select("_id", "team", "content", "variant")
    got = summaries.summarize(pairs, SpreadChat(ANSWER_WORDS), SUMMARY_CHUNK_TOKENS)
    return got.select(F.col("_id").alias("doc_id"), "variant", "summary", "error", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_failed").cast("long").alias("n_failed"))


def scored_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = evaluate.eval_items(filled_docs(spark, sf))
    return items, evaluate.score_items(items)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    _, scored = scored_items(spark, sf)
    # scores and labels only, written once: the long rows and the labels are both read from it
    scored = cut_lineage(scored)
    return evaluate.wide_results(scored, evaluate.long_scores(scored))


def rag_answers(spark: SparkSession, sf: str) -> DataFrame:
    emb = HashingEmbedder(EMBED_DIM)
    corpus = tables.documents(spark, sf, "doc_id", "text").select(
        "doc_id", F.col("text").alias("summary_text"), emb.embed("text").alias("embedding")
    )
    questions = tables.questions(spark, sf).withColumnRenamed("item_id", "query_id")
    hits = rag.retrieve(questions, corpus, emb, TOP_K, c_id="doc_id")
    ctx = hits.groupBy("query_id").agg(
        rag.ordered_concat("rank", "summary_text").alias("context"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("hit_ids"),
    )
    out = questions.join(ctx.hint("merge"), "query_id", "left").select(
        F.col("query_id").alias("item_id"),
        "question",
        F.coalesce("hit_ids", F.lit("")).alias("hit_ids"),
        F.coalesce("context", F.lit("")).alias("context"),
    )
    out = out.withColumn("prompt", rag.rag_prompt("context", "question"))
    out = answered(out, SpreadChat(ANSWER_WORDS), F.lit(""), F.col("prompt"))
    return out.withColumn("answer", F.coalesce("_answer.value", F.lit(""))).drop("_answer")


# --------------------------------------------------------------------------- queries


def q_knn_topk(spark, sf):
    emb = tables.embeddings(spark, sf)
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = exact_topk(q, emb, TOP_K, exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", "label", _r("cosine").alias("cosine"), _r("search_score").alias("search_score"))


def q_word_stats(spark, sf):
    d = tables.documents(spark, sf, "doc_id", "text")
    return d.select(
        "doc_id",
        tx.word_count("text").alias("n_words"),
        tx.rough_tokens("text").alias("rough_tokens"),
        F.length(tx.strip_ws("text")).cast("bigint").alias("stripped_chars"),
        tx.is_blank("text").alias("is_blank"),
    )


def q_chunk_words(spark, sf):
    d = tables.documents(spark, sf, "doc_id", "text")
    ch = chunking.explode_chunks(d, "text", CHUNK_WORDS_TOKENS, keep=["doc_id"])
    return ch.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), tx.word_count("chunk").alias("n_words"), "chunk")


def q_html_clean(spark, sf):
    p = tables.pages(spark, sf, "page_id", "html")
    return p.select("page_id", clean_html_exact("html").alias("text"))


def q_page_title(spark, sf):
    p = tables.pages(spark, sf, "page_id", "url")
    return p.select("page_id", page_title("url").alias("title"))


def q_article_assemble(spark, sf):
    d = tables.documents(spark, sf, "doc_id", "text")
    secs = articles.sections_from_documents(d)
    return articles.assemble_articles(secs, ["doc_id"], "title").select(
        "doc_id", F.col("n_sections").cast("bigint").alias("n_sections"), "article"
    )


def q_page_articles(spark, sf):
    """SRC4 + SC1-SC5 + UN2 + SC6-SC9 + AG10 on page HTML: one article per page."""
    p = tables.pages(spark, sf, "page_id", "url", "html")
    secs = articles.sections_from_pages(p)
    return articles.assemble_articles(secs, ["page_id"], "title").select(
        "page_id", F.col("n_sections").cast("bigint").alias("n_sections"), "article"
    )


def _upsert_inputs(spark, sf):
    d = tables.documents(spark, sf, "doc_id", "text", "lang", "source", spread_rows=False).select(
        "lang", "source", "doc_id", F.col("text").alias("content")
    )
    first = d.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    stored = d.join(first, ["lang", "source", "doc_id"], "left_semi")
    batch = d.join(first, ["lang", "source", "doc_id"], "left_anti").withColumn("seq", F.col("doc_id"))
    return stored, batch


def q_upsert_snapshot(spark, sf):
    stored, batch = _upsert_inputs(spark, sf)
    snap, _ = ingest.upsert(stored, batch, keys=["lang", "source"], seq="seq")
    return snap.select("lang", "source", "doc_id", "content")


def q_upsert_actions(spark, sf):
    stored, batch = _upsert_inputs(spark, sf)
    _, actions = ingest.upsert(stored, batch, keys=["lang", "source"], seq="seq")
    return ingest.action_counts(actions)


def q_upsert_bucketed(spark, sf):
    """SNK2 + JN2: the upsert into a bucketed table, of which only changed buckets are written again."""
    from quire.sources import buckets

    stored, batch = _upsert_inputs(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    buckets.create(stored, path, ["lang", "source"], BUCKETS)
    buckets.upsert_into(spark, path, batch)
    return buckets.read(spark, path).select("lang", "source", "doc_id", "content")


def q_stream_snapshot(spark, sf):
    """2.12: three drops of version files and a replay of the second, through the stateful stream."""
    from quire.streaming.changes import run_change_stream

    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stored, batch = _upsert_inputs(spark, sf)
    versions = stored.withColumn("seq", F.col("doc_id")).unionByName(batch)
    low, high = versions.agg(F.min("seq"), F.max("seq")).first()
    third = (F.col("seq") - low) * DROPS / ((high or 0) - (low or 0) + 1)
    for k in [*range(DROPS), 1]:
        versions.where(F.floor(third) == k).write.mode("append").parquet(f"{root}/versions/drop-{uuid.uuid4().hex}")
        run_change_stream(spark, f"{root}/versions/*", versions.schema, f"{root}/table", f"{root}/state", ["lang", "source"], n_buckets=BUCKETS)
    return spark.read.parquet(f"{root}/table/rows").select("lang", "source", "doc_id", "content")


def q_missing_pairs(spark, sf):
    pairs = summaries.missing_pairs(corpus_docs(spark, sf))
    return pairs.select(F.col("_id").alias("doc_id"), "variant")


def q_prompt_fill(spark, sf):
    d = corpus_docs(spark, sf).select("_id", "team", "content")
    d = d.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in summaries.VARIANT_NAMES])))
    return d.select(
        F.col("_id").alias("doc_id"), "variant", summaries._prompt_for(F.col("variant"), F.col("team"), F.col("content")).alias("prompt")
    )


def q_summary_fill(spark, sf):
    f = filled_docs(spark, sf)
    return f.select(F.col("_id").alias("doc_id"), F.explode("summaries").alias("variant", "summary"))


def q_summary_stored(spark, sf):
    """ML2: the summary fill over stored completions; the second run reads every answer and makes no call but for failed ones."""
    path = f"{ensure_checkpoint_dir(spark)}/completions-{uuid.uuid4().hex}"
    model = StoredChat(SpreadChat(ANSWER_WORDS), f"spread-{ANSWER_WORDS}", path)
    docs = corpus_docs(spark, sf)
    for _ in range(2):
        filled = summaries.incremental_summaries(docs, model, SUMMARY_CHUNK_TOKENS)
    return filled.select(F.col("_id").alias("doc_id"), F.explode("summaries").alias("variant", "summary"))


def q_missing_vectors_by_key(spark, sf):
    """JN5 against a catalogue table in buckets of its key: the stored side of the anti join is not moved."""
    from quire.sources import tables_by_key

    name = f"vectors_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    stored = corpus_docs(spark, sf).filter(F.col("toxic") == 0).select("team", F.explode("summaries").alias("summary_type", "summary_text"))
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables_by_key.create_if_absent(stored.select(*VECTOR_KEYS).distinct(), name, path, VECTOR_KEYS, buckets)
    return _missing_vector_ids(spark, sf, spark.table(name))


def q_missing_vectors(spark, sf):
    stored = corpus_docs(spark, sf).filter(F.col("toxic") == 0).select(
        "team", F.explode("summaries").alias("summary_type", "summary_text")
    )
    return _missing_vector_ids(spark, sf, stored.select(*VECTOR_KEYS))


def _missing_vector_ids(spark, sf, stored):
    f = filled_docs(spark, sf).select(
        F.col("team"), "_id", "summaries", F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("timestamp").alias("timestamp"),
    )
    rows = missing_vector_rows(f, stored, carry=["_id"])
    return rows.select(F.col("_id").alias("doc_id"), "summary_type")


def q_rag_context(spark, sf):
    return rag_answers(spark, sf).select("item_id", "hit_ids", "context", "answer")


def q_chat_messages(spark, sf):
    conv = tables.read_table(spark, sf, "conversations")
    msgs = rag.conversation_messages(conv)
    return msgs.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n").alias("transcript"),
    )


def q_greedy_match(spark, sf):
    emb = tables.embeddings(spark, sf)
    cand = emb.select("vec_id", "embedding", F.col("label").alias("pair_id"))
    ref = emb.select("vec_id", "embedding", F.pmod(F.col("label") - 1, F.lit(N_LABELS)).alias("pair_id"))
    g = greedy_match(cand, ref, "pair_id")
    return g.select(F.col("pair_id").cast("int").alias("pair_id"), _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"))


def q_lexical_prf(spark, sf):
    _, s = scored_items(spark, sf)
    return s.select("item_id", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"))


def q_tf_cosine(spark, sf):
    _, s = scored_items(spark, sf)
    return s.select("item_id", _r("cosine").alias("cosine"))


def q_embedding_cosine(spark, sf):
    """ML8 with an embedder: how close each turn of a conversation is to the next one."""
    turns = tables.read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("reference", following).where("reference IS NOT NULL").withColumnRenamed("text", "candidate")
    return embedding_cosine(pairs, HashingEmbedder(EMBED_DIM)).select("conv_id", "turn", _r("cosine").alias("cosine"))


def q_combined_score(spark, sf):
    _, s = scored_items(spark, sf)
    return s.select("item_id", _r("combined").alias("combined_score"))


def q_score_rows(spark, sf):
    """UN6 + AG5 input: the evaluator's long score rows ``(item_id, ordinal, name, value)``."""
    _, s = scored_items(spark, sf)
    return evaluate.long_scores(s).select("item_id", F.col("ordinal").cast("int").alias("ordinal"), "name", _r("value").alias("value"))


def q_eval_wide(spark, sf):
    w = wide(spark, sf)
    return w.select(
        "item_id", "team", "summary_type",
        *[_r(c).alias(c) for c in ("bert_precision", "bert_recall", "bert_f1", "cosine_similarity", "combined_score")],
        "summary_length", "article_length",
    )


def vector_wide(spark: SparkSession, sf: str) -> DataFrame:
    docs = filled_docs(spark, sf)
    scored = cut_lineage(evaluate.vector_scored_items(docs, TrigramTokens(TOKEN_DIM), HashingEmbedder(EMBED_DIM)))
    return evaluate.wide_results(scored, evaluate.long_scores(scored))


def q_eval_vectors(spark, sf):
    """ML7 + ML8 + JN8 by models: the wide table from token vectors and text vectors."""
    w = vector_wide(spark, sf)
    return w.select(
        "item_id", "team", "summary_type",
        *[_r(c).alias(c) for c in ("bert_precision", "bert_recall", "bert_f1", "cosine_similarity", "combined_score")],
        "summary_length", "article_length",
    )


def q_eval_missing(spark, sf):
    """JN7 + AG5 + PR7: the wide table when ``recent`` items have no scores and ``achievements`` items no team."""
    scored = cut_lineage(scored_items(spark, sf)[1])
    items = scored.withColumn("team", F.when(F.col("summary_type") != "achievements", F.col("team")))
    w = evaluate.wide_results(items, evaluate.long_scores(scored.where("summary_type <> 'recent'")))
    return w.select("item_id", "team", "summary_type", _r("bert_f1").alias("bert_f1"), _r("combined_score").alias("combined_score"), "summary_length")


def q_eval_report(spark, sf):
    r = evaluate.type_report(wide(spark, sf))
    return r.select("summary_type", _r("bert_f1").alias("bert_f1"), _r("cosine_similarity").alias("cosine_similarity"), _r("combined_score").alias("combined_score"), "line")


def q_eval_best_worst(spark, sf):
    b = evaluate.best_worst(wide(spark, sf))
    return b.select("which", "team", "summary_type", _r("combined_score").alias("combined_score"), "item_id")


def _stored_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table scored as three runs, of which the second is run again."""
    from quire.operators import report_parts

    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    w = cut_lineage(wide(spark, sf))
    for k in [*range(DROPS), 1]:
        report_parts.store_part(w.where(F.pmod(F.crc32("item_id"), F.lit(DROPS)) == k), path, f"run-{k}")
    return report_parts.read_parts(spark, path)


def q_report_merged(spark, sf):
    """AG2 + OB3: the report over three stored runs, from their counts and sums."""
    from quire.operators.report_parts import merged_report

    r = merged_report(_stored_parts(spark, sf))
    return r.select("summary_type", *[_r(c).alias(c) for c in ("bert_f1", "cosine_similarity", "combined_score")], "line", "n_items")


def q_best_worst_merged(spark, sf):
    """AG3: best and worst item over three stored runs."""
    from quire.operators.report_parts import merged_best_worst

    b = merged_best_worst(_stored_parts(spark, sf))
    return b.select("which", "team", "summary_type", _r("combined_score").alias("combined_score"), "item_id")


def q_judge_scores(spark, sf):
    a = rag_answers(spark, sf)
    ans = F.array_distinct(tx.lower_terms("answer"))
    qt = F.array_distinct(tx.lower_terms("question"))
    known = F.array_union(tx.lower_terms("context"), tx.lower_terms("question"))
    hall = F.when(F.size(ans) > 0, F.size(F.array_except(ans, known)) / F.size(ans))
    rel = F.when(F.size(qt) > 0, F.size(F.array_intersect(qt, tx.lower_terms("answer"))) / F.size(qt))
    return a.select("item_id", _r(hall).alias("hallucination"), _r(rel).alias("answer_relevance"))


def q_vector_contract(spark, sf):
    emb = tables.embeddings(spark, sf)
    return emb.select(
        "vec_id", F.size("embedding").cast("bigint").alias("dim"), _r(norm("embedding")).alias("norm"),
        contract_violation("embedding", VECTOR_DIM).alias("violation"),
    )


def q_spans(spark, sf):
    """OB1: a root span and one span per traced step for every RAG question."""
    from quire.operators.observe import traced_spans

    a = rag_answers(spark, sf).select("item_id", F.when(F.col("answer") == "", F.lit("empty answer")).alias("error"))
    return traced_spans(a, rag.SPAN_ROOT, rag.SPAN_STEPS, ["item_id"], "error").select(
        "trace_id", "span_id", "parent_id", "name", "status"
    )


def q_ann_recall(spark, sf):
    """TK2: recall@3 of the approximate search against the exact one (no SQL oracle)."""
    from quire.operators.ann import approx_topk, recall_at_k

    emb = tables.embeddings(spark, sf)
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = exact_topk(q, emb, TOP_K, exclude_self=True).select("query_id", "vec_id")
    approx = approx_topk(q, emb, TOP_K, num_candidates=NUM_CANDIDATES, exclude_self=True)
    return recall_at_k(exact, approx, TOP_K)


def q_ann_topk(spark, sf):
    """TK2: candidates over one-byte codes, re-ranked exactly."""
    from quire.operators.ann import approx_topk

    emb = tables.embeddings(spark, sf, "vec_id", "embedding")
    hits = approx_topk(emb.withColumnRenamed("vec_id", "query_id"), emb, TOP_K, num_candidates=NUM_CANDIDATES, exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", _r("cosine").alias("cosine"))


def _ivf_index(spark, emb) -> str:
    """A fresh index of the table in the shared folder."""
    from quire.operators import ivf

    path = f"{ensure_checkpoint_dir(spark)}/ivf-{uuid.uuid4().hex}"
    ivf.build_index(emb, path, rounds=IVF_ROUNDS)
    return path


def q_ivf_topk(spark, sf):
    """TK2 + JN6: candidates from the nearest inverted lists only (the test vectors are spread evenly: most lists are needed)."""
    from quire.operators import ivf

    emb = tables.embeddings(spark, sf, "vec_id", "embedding")
    path = _ivf_index(spark, emb)
    probes = math.ceil(IVF_SHARE * len(ivf.stored_centroids(spark, path)))
    hits = ivf.ivf_topk(emb.withColumnRenamed("vec_id", "query_id"), path, TOP_K, probes, exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", _r("cosine").alias("cosine"))


def q_ivf_exact(spark, sf):
    """TK2: probing every list is the exact search, row by row (the oracle is that of ``knn_topk``)."""
    from quire.operators import ivf

    emb = tables.embeddings(spark, sf)
    path = _ivf_index(spark, emb)
    hits = ivf.ivf_topk(emb.select(F.col("vec_id").alias("query_id"), "embedding"), path, TOP_K, len(ivf.stored_centroids(spark, path)), exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", "label", _r("cosine").alias("cosine"), _r("search_score").alias("search_score"))


def q_ivf_recall(spark, sf):
    """TK2: lists, probes, share of all pairs compared, and recall@3 of that search (rows only)."""
    from quire.operators import ivf
    from quire.operators.ann import recall_at_k

    emb = tables.embeddings(spark, sf, "vec_id", "embedding")
    q = emb.withColumnRenamed("vec_id", "query_id")
    path = _ivf_index(spark, emb)
    probes = math.ceil(IVF_SHARE * len(ivf.stored_centroids(spark, path)))
    exact = exact_topk(q, emb, TOP_K, exclude_self=True).select("query_id", "vec_id")
    found = recall_at_k(exact, ivf.ivf_topk(q, path, TOP_K, probes, exclude_self=True), TOP_K)
    work = ivf.compared(q, path, probes).first()
    return found.withColumns({c: F.lit(work[c]) for c in ("lists", "probes", "share_compared")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_topk": q_knn_topk,
    "word_stats": q_word_stats,
    "chunk_words": q_chunk_words,
    "html_clean": q_html_clean,
    "page_title": q_page_title,
    "article_assemble": q_article_assemble,
    "page_articles": q_page_articles,
    "upsert_snapshot": q_upsert_snapshot,
    "upsert_actions": q_upsert_actions,
    "upsert_bucketed": q_upsert_bucketed,
    "stream_snapshot": q_stream_snapshot,
    "missing_pairs": q_missing_pairs,
    "prompt_fill": q_prompt_fill,
    "summary_fill": q_summary_fill,
    "summary_errors": q_summary_errors,
    "summary_stored": q_summary_stored,
    "missing_vectors": q_missing_vectors,
    "missing_vectors_by_key": q_missing_vectors_by_key,
    "rag_context": q_rag_context,
    "chat_messages": q_chat_messages,
    "greedy_match": q_greedy_match,
    "lexical_prf": q_lexical_prf,
    "tf_cosine": q_tf_cosine,
    "combined_score": q_combined_score,
    "embedding_cosine": q_embedding_cosine,
    "score_rows": q_score_rows,
    "eval_wide": q_eval_wide,
    "eval_vectors": q_eval_vectors,
    "eval_missing": q_eval_missing,
    "eval_report": q_eval_report,
    "eval_best_worst": q_eval_best_worst,
    "report_merged": q_report_merged,
    "best_worst_merged": q_best_worst_merged,
    "judge_scores": q_judge_scores,
    "vector_contract": q_vector_contract,
    "spans": q_spans,
    "ann_topk": q_ann_topk,
    "ann_recall": q_ann_recall,
    "ivf_topk": q_ivf_topk,
    "ivf_exact": q_ivf_exact,
    "ivf_recall": q_ivf_recall,
}

from quire.plans.oracles import ORACLES  # noqa: E402  (SQL lives next door)

__all__ = ["QUERIES", "ORACLES", "tables", "ingest"]
