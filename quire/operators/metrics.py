"""Summary metrics (ML7, ML8, ML9, AG8, JN8, SC21, FL6, FL7).

* Greedy token matching (AG8): every candidate token takes its best cosine
  over the reference tokens (precision), every reference token its best over
  the candidate tokens (recall), F1 is the harmonic mean.  With vectors this
  is a top-1 search per side (:func:`greedy_match`), so no token pair is ever
  materialised.  With identity token vectors it is lexical matching
  (:func:`lexical_scores`): a token scores 1 when it occurs on the other side.
* Cosine (ML8): term-frequency cosine, the offline stand-in for a sentence
  encoder; any embedder can be plugged via :func:`embedding_cosine`.
* Combined (ML9): ``bert_weight * f1 + cosine_weight * cosine`` computed once
  from the columns above (no recomputation).

Three physical forms of the lexical scores, same numbers:

* :func:`term_scores` (used by the evaluation): per item row, term counts of
  both sides in Arrow batches, a bounded number of terms at once; cost per
  item is the number of its terms.
* :func:`row_lexical_scores`: the same without Python, per item row, from the
  candidate's distinct terms and the reference's sorted term array computed
  once per document (:func:`reference_stats`).  No shuffle at all, so a hot
  term or a hot document cannot skew a task; cost per item is
  O(distinct candidate terms x reference terms) with native array scans.
* :func:`lexical_scores`: when candidates and references live in separate
  tables - one join on ``(reference key, term)`` over per-text term counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let, lower_terms, non_blank
from quire.operators.knn import exact_topk

BERT_WEIGHT = 0.6
COSINE_WEIGHT = 0.4


def check_weights(bert_weight: float, cosine_weight: float) -> None:
    """FL7: the blend weights must sum to 1 (within 0.01)."""
    total = bert_weight + cosine_weight
    if not 0.99 <= total <= 1.01:
        raise ValueError("bert_weight and cosine_weight must sum to 1.0")


def f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).when(p.isNotNull() & r.isNotNull(), F.lit(0.0))


def combined(f1_col: Column | str, cos_col: Column | str, bert_weight: float = BERT_WEIGHT, cosine_weight: float = COSINE_WEIGHT) -> Column:
    """SC21 / ML9."""
    check_weights(bert_weight, cosine_weight)
    a = F.col(f1_col) if isinstance(f1_col, str) else f1_col
    b = F.col(cos_col) if isinstance(cos_col, str) else cos_col
    return a * F.lit(bert_weight) + b * F.lit(cosine_weight)


def _term_counts(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return (
        df.select(*key, F.explode(lower_terms(text)).alias("term"))
        .groupBy(*key, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lexical_scores(
    items: DataFrame,
    references: DataFrame,
    item_key: str = "item_id",
    ref_key: str = "doc_id",
    candidate: str = "candidate",
    reference: str = "reference",
    strict: bool = False,
) -> DataFrame:
    """ML7 (identity vectors) + ML8 (tf cosine) per item.

    ``items``: ``item_key, ref_key, candidate``; ``references``: ``ref_key, reference``.
    Returns ``item_key, precision, recall, f1, cosine, error``.  Blank input
    gives NULL scores and an error (FL6); ``strict=True`` raises instead.
    """
    cand = items.select(item_key, ref_key, candidate)
    refs = references.select(ref_key, reference)
    if strict:
        bad = cand.filter(~non_blank(candidate)).limit(1).count() + refs.filter(~non_blank(reference)).limit(1).count()
        if bad:
            raise ValueError("Input texts cannot be empty or whitespace.")
    c_terms = _term_counts(cand, [item_key, ref_key], candidate)
    r_terms = _term_counts(refs.join(cand.select(ref_key).distinct(), ref_key, "left_semi"), [ref_key], reference)
    r_tot = r_terms.groupBy(ref_key).agg(
        F.sum("n").alias("r_total"), F.sum(F.col("n") * F.col("n")).alias("r_sq")
    )
    # candidate side of the join: per (item, term); reference side: per (doc, term)
    j = c_terms.alias("c").join(r_terms.alias("r"), [ref_key, "term"], "left")
    per_item = j.groupBy(item_key, ref_key).agg(
        F.sum("c.n").alias("c_total"),
        F.sum(F.when(F.col("r.n").isNotNull(), F.col("c.n")).otherwise(0)).alias("c_hit"),
        F.sum(F.col("c.n") * F.col("c.n")).alias("c_sq"),
        F.sum(F.coalesce(F.col("c.n") * F.col("r.n"), F.lit(0))).alias("dot"),
        F.sum(F.coalesce(F.col("r.n"), F.lit(0))).alias("r_hit"),
    )
    s = per_item.join(r_tot, ref_key, "left")
    p = (F.col("c_hit") / F.col("c_total")).cast("double")
    r = (F.col("r_hit") / F.col("r_total")).cast("double")
    cos = F.col("dot") / (F.sqrt(F.col("c_sq").cast("double")) * F.sqrt(F.col("r_sq").cast("double")))
    scored = s.select(item_key, p.alias("precision"), r.alias("recall"), cos.alias("cosine")).withColumn(
        "f1", f1(F.col("precision"), F.col("recall"))
    )
    flagged = cand.join(refs, ref_key, "left").select(
        item_key,
        F.when(~non_blank(candidate) | ~non_blank(reference), F.lit("Input texts cannot be empty or whitespace.")).alias("error"),
    )
    out = flagged.join(scored, item_key, "left")
    ok = F.col("error").isNull()
    return out.select(
        item_key,
        *[F.when(ok, F.col(c)).alias(c) for c in ("precision", "recall", "f1", "cosine")],
        "error",
    )


def reference_stats(reference: Column | str) -> Column:
    """:func:`reference_stats_from_terms` of a text."""
    return reference_stats_from_terms(lower_terms(reference))


def reference_stats_from_terms(terms: Column) -> Column:
    """Per-reference term statistics, computed once per text (no shuffle).

    ``struct<terms: sorted ARRAY<STRING>, total: BIGINT, sq: BIGINT>`` where
    ``sq`` is the sum of squared term counts (a run-length fold over the
    sorted terms).
    """
    def runs(sorted_terms: Column) -> Column:
        init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("ss"))
        sq = F.aggregate(
            sorted_terms,
            init,
            lambda acc, x: F.when(acc["prev"] == x, F.struct(x.alias("prev"), (acc["run"] + 1).alias("run"), acc["ss"].alias("ss"))).otherwise(
                F.struct(x.alias("prev"), F.lit(1).cast("long").alias("run"), (acc["ss"] + acc["run"] * acc["run"]).alias("ss"))
            ),
            lambda acc: acc["ss"] + acc["run"] * acc["run"],
        )
        return F.struct(sorted_terms.alias("terms"), F.size(sorted_terms).cast("long").alias("total"), sq.alias("sq"))

    return let(F.array_sort(terms), runs)


def row_lexical_scores(candidate: Column | str, ref: Column | str) -> Column:
    """ML7 + ML8 for one (candidate, reference statistics) pair, per row.

    For each distinct candidate term the counts on both sides come from
    native ``array_remove`` scans; precision, recall, F1 and the
    term-frequency cosine follow from five integer sums.  NULL scores when
    either side has no terms.
    """
    r = F.col(ref) if isinstance(ref, str) else ref

    def per_candidate(c: Column) -> Column:
        def per_distinct(cs: Column) -> Column:
            stats = F.transform(
                cs,
                lambda t: F.struct(
                    (F.size(c) - F.size(F.array_remove(c, t))).cast("long").alias("nc"),
                    (F.size(r["terms"]) - F.size(F.array_remove(r["terms"], t))).cast("long").alias("nr"),
                ),
            )

            def sums(st: Column) -> Column:
                zero = F.lit(0).cast("long")
                c_hit = F.aggregate(st, zero, lambda a, x: a + F.when(x["nr"] > 0, x["nc"]).otherwise(0))
                r_hit = F.aggregate(st, zero, lambda a, x: a + x["nr"])
                dot_ = F.aggregate(st, zero, lambda a, x: a + x["nc"] * x["nr"])
                c_sq = F.aggregate(st, zero, lambda a, x: a + x["nc"] * x["nc"])
                c_total = F.size(c).cast("long")
                ok = (c_total > 0) & (r["total"] > 0)
                p = F.when(ok, c_hit.cast("double") / c_total.cast("double"))
                rec = F.when(ok, r_hit.cast("double") / r["total"].cast("double"))
                cos = F.when(ok, dot_.cast("double") / (F.sqrt(c_sq.cast("double")) * F.sqrt(r["sq"].cast("double"))))
                return F.struct(p.alias("precision"), rec.alias("recall"), cos.alias("cosine"))

            return let(stats, sums)

        return let(F.array_distinct(c), per_distinct)

    return let(lower_terms(candidate), per_candidate)


#: terms of both sides that are counted at once (or those of one item)
TERMS_AT_ONCE = 1 << 18


def _counted(c: pa.Array, r: pa.Array) -> pa.Array:
    """Scores of a slice of term lists: the terms become numbers, an item's counts are runs of one sorted array."""
    n = len(c)
    sizes = [pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (c, r)]
    terms = pa.concat_arrays([c.flatten(), r.flatten()]).dictionary_encode(null_encoding="encode")
    known = max(len(terms.dictionary), 1)
    keys = np.repeat(np.tile(np.arange(n), 2), np.concatenate(sizes)) * known + terms.indices.to_numpy()
    (ours, n_ours), (theirs, n_theirs) = (np.unique(k, return_counts=True) for k in np.split(keys, [sizes[0].sum()]))
    at = np.searchsorted(theirs, ours)
    both = at < len(theirs)
    both[both] = theirs[at[both]] == ours[both]
    item, matched = ours // known, np.zeros(len(ours), np.int64)
    matched[both] = n_theirs[at[both]]
    total = lambda rows, values: np.bincount(rows, values, n)  # noqa: E731 - whole numbers, exact in doubles
    ok = (sizes[0] > 0) & (sizes[1] > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        precision = total(item, n_ours * both) / sizes[0]
        recall = total(item, matched) / sizes[1]
        cosine = total(item, n_ours * matched) / (np.sqrt(total(item, n_ours * n_ours)) * np.sqrt(total(theirs // known, n_theirs * n_theirs)))
    return pa.StructArray.from_arrays([pa.array(x, pa.float64(), mask=~ok) for x in (precision, recall, cosine)], ["precision", "recall", "cosine"])


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items with at most ``TERMS_AT_ONCE`` terms, or one item each."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TERMS_AT_ONCE, "right")))
        yield start, end - start
        start = end


def _scores(candidates: pa.Array, references: pa.Array) -> pa.Array:
    """:func:`_counted`, slice by slice."""
    sizes = sum(pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (candidates, references))
    parts = [_counted(candidates.slice(a, n), references.slice(a, n)) for a, n in _slices(sizes)]
    return pa.concat_arrays(parts) if parts else _counted(candidates, references)


def term_scores(candidate: Column | str, reference: Column | str) -> Column:
    """:func:`row_lexical_scores` of two term arrays, counted in Arrow batches.

    No term becomes a Python object, and a batch (which Spark bounds in rows and bytes) is counted in slices of
    ``TERMS_AT_ONCE`` terms: a worker holds the batch and what one slice takes.
    """

    @F.arrow_udf("struct<precision: double, recall: double, cosine: double>")
    def scored(candidates: pa.Array, references: pa.Array) -> pa.Array:
        return _scores(candidates, references)

    return scored(candidate, reference)


def embedding_cosine(df: DataFrame, embedder, candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """ML8 with a pluggable embedder: adds ``cosine`` of the two embeddings.

    The embeddings are projected first (Python UDFs cannot sit inside the
    cosine's higher-order functions).
    """
    from quire.functions.vectors import cosine

    e = df.withColumn("_ce", embedder.embed(candidate)).withColumn("_re", embedder.embed(reference))
    return e.withColumn("cosine", cosine("_ce", "_re")).drop("_ce", "_re")


def greedy_match(
    cand_vectors: DataFrame,
    ref_vectors: DataFrame,
    pair_col: str = "pair_id",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """AG8 + JN8 with token vectors: per pair ``precision, recall, f1``.

    Each side is a top-1 search restricted to the same pair, run through the
    exact top-k operator (no token-pair rows).  Token ids are unique within a
    pair and side; other pairs may use them too.
    """

    def side(queries: DataFrame, corpus: DataFrame, name: str) -> DataFrame:
        q = queries.select(F.col(id_col).alias("query_id"), vec_col, pair_col)
        c = corpus.select(id_col, vec_col, pair_col)
        best = exact_topk(q, c, 1, c_id=id_col, c_vec=vec_col, group_cols=[pair_col])
        return best.groupBy(pair_col).agg(F.avg("cosine").alias(name))

    p = side(cand_vectors, ref_vectors, "precision")
    r = side(ref_vectors, cand_vectors, "recall")
    out = p.join(r, pair_col, "full")
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
