"""Retrieval-augmented answering for a batch of questions (ML5, JN9, AG6, SC13, SC17, SC22).

questions -> embed (ML1) -> exact top-k (TK1/WN2) -> ordered context (AG6)
-> prompt (SC13) -> answer (ML2).  Python is crossed only inside the model
plug points; the stand-ins keep everything in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import _c, fill_template
from quire.operators.joins import broadcast_if_small
from quire.operators.knn import exact_topk
from quire.operators.stored import answered, embedded
from quire.session import cut_lineage

# Ids of hits are broadcast only below this many rows.
HIT_IDS_BROADCAST_ROWS = 100_000

# The question-answering prompt.
QUERY_PROMPT = """
                You are a helpful assistant. Based on the context below, answer the question concisely.

                Context:
                {context}

                {query}
                Answer:
                """
CONTEXT_SEPARATOR = "\n\n"

# Names of the traced steps of one question-answering call.
SPAN_ROOT = "rag_query_pipeline"
SPAN_STEPS = ["get_embedding", "prepare_context", "generate_answer"]


def ordered_concat(order: str, text: str, sep: str = CONTEXT_SEPARATOR) -> Column:
    """AG6: texts of a group joined in ``order`` (aggregate expression)."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]),
        sep,
    )


def retrieve(questions: DataFrame, corpus: DataFrame, embedder, k: int = 3, **knn) -> DataFrame:
    """Embed the questions and return their top-k hits (``query_id, rank, ...``).

    The search sees ids and vectors only; the other columns are read for the hits.  Ids are unique.
    """
    c_id, c_vec, groups = knn.get("c_id", "vec_id"), knn.get("c_vec", "embedding"), list(knn.get("group_cols", ()))
    q = embedded(questions.select("query_id", "question", *groups), embedder, "question").drop("question")
    hits = exact_topk(q, corpus.select(c_id, c_vec, *groups), k, **knn)
    others = [c for c in corpus.columns if c not in (c_id, c_vec, *groups)]
    if not others:
        return hits
    hits = cut_lineage(hits)  # k rows a question
    wanted = broadcast_if_small(hits.select(c_id).distinct(), HIT_IDS_BROADCAST_ROWS)
    texts = corpus.select(c_id, *others).join(wanted, c_id, "left_semi")
    # whole texts: never broadcast
    found = hits.join(texts.hint("merge"), c_id)
    return found.select("query_id", "rank", *corpus.drop(c_vec).columns, "cosine", "search_score")


def contexts(questions: DataFrame, hits: DataFrame, text_col: str = "summary_text") -> DataFrame:
    """JN9: one context per question; questions without a hit get ''."""
    ctx = hits.groupBy("query_id").agg(ordered_concat("rank", text_col).alias("context"))
    # contexts hold whole texts: never let the planner broadcast them
    return questions.join(ctx.hint("merge"), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def rag_prompt(context: Column | str, query: Column | str) -> Column:
    """SC13 with the question prompt."""
    return fill_template(QUERY_PROMPT, context=_c(context), query=_c(query))


def user_messages(prompt: Column | str) -> Column:
    """SC22: a one-message chat ``[{role: 'user', content: prompt}]``."""
    return F.array(F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """SC22 multi-turn: ``conversations`` rows -> ordered message array per conversation."""
    return turns.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")),
        ).alias("messages")
    )


def answer(questions: DataFrame, corpus: DataFrame, embedder, model, k: int = 3, text_col: str = "summary_text", **knn) -> DataFrame:
    """ML5: questions ``(query_id, question)`` -> context, prompt and answer ('' when NULL, SC17)."""
    hits = retrieve(questions, corpus, embedder, k, **knn)
    c = contexts(questions, hits, text_col)
    c = c.withColumn("prompt", rag_prompt("context", "question"))
    return answered(c, model, F.lit(""), F.col("prompt")).withColumn("answer", F.coalesce("_answer.value", F.lit(""))).drop("_answer")
