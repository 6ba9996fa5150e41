"""Incremental summarisation (JN3, JN4, UN4, FL2, FL4, AG6, AG7, SC13, SC23, ML3, ML4, SNK3).

Work units are (document, variant) pairs whose summary is missing or blank.
Single-chunk documents get the variant prompt; multi-chunk documents get one
generic call per chunk, failed partials dropped, then one combine call
(the variant prompt is not used on that path, as in the reference).  Every
group is one document, so ordered concatenation is bounded per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import _c, fill_template, non_blank
from quire.operators.chunking import chunk_array
from quire.operators.stored import answered

# Summary variants (prompt text and completion limit).
VARIANTS: dict[str, dict] = {
    "default": {
        "prompt": """Create a comprehensive summary of {team} from the following Wikipedia content:

                Content:
                {content}

                Expected sections:
                1. **Overview & History**
                2. **Stadium & Facilities**
                3. **Major Achievements**
                4. **Notable Players & Management**
                5. **Recent Performance**
                6. **Culture & Rivalries**

                Keep it factual, structured
                """,
        "max_tokens": 1200,
    },
    "recent": {
        "prompt": """Write a summary of {team} about its recent achievements focusing on from the following content:

                Content:
                {content}

                Expected sections:
                1. **Recent Achievements (2020-2025)**
                2. **Current Performance (2023-2025)**
                3. **Latest Developments (2025)**

                Keep it factual, structured.
                """,
        "max_tokens": 1200,
    },
    "achievements": {
        "prompt": """Write a summary of {team} about its overall historical achievements focusing
                     on from the following content:

                Content:
                {content}

                Expected sections:
                1. **Major Trophies**
                2. **Records & Milestones**
                3. **Historical Significance**

                Keep it factual, structured.
                """,
        "max_tokens": 1200,
    },
}
VARIANT_NAMES = list(VARIANTS)

# Prompts of the single-chunk and multi-chunk paths.
SYSTEM_SINGLE = "You are an expert sports journalist."
SYSTEM_PART = "You condense football Wikipedia sections."
SYSTEM_COMBINE = "You compile football summaries."
PART_PREFIX = "Summarize the following part about {team}:\n\n"
COMBINE_PREFIX = "Combine the following parts into a cohesive summary:\n\n"
PART_SEPARATOR = "\n\n"


def variant_lookup(summaries: Column | str, variant: Column | str) -> Column:
    """SC23: ``summaries.get(variant)`` (NULL map or missing key -> NULL)."""
    return F.try_element_at(_c(summaries), _c(variant))


def missing_pairs(docs: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """JN3 + JN4 + FL2: (document, variant) pairs that still need a summary.

    ``docs`` has ``_id, team, content, summaries``.  The 3-row variant list is
    a literal array, so the "cross join" is a per-row explode (no join).
    """
    variants = variants or VARIANT_NAMES
    d = docs.filter(non_blank("content"))
    pairs = d.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    return pairs.filter(~non_blank(variant_lookup("summaries", "variant")))


def _prompt_for(variant: Column, team: Column, content: Column) -> Column:
    expr = None
    for name, cfg in VARIANTS.items():
        filled = fill_template(cfg["prompt"], team=team, content=content)
        expr = (expr if expr is not None else F).when(variant == name, filled)
    return expr


def summarize(
    pairs: DataFrame, model, chunk_tokens: int = 100_000, materialize: bool = True, model_partitions: int | None = None
) -> DataFrame:
    """ML3 -> ``(_id, variant, summary, error, n_chunks, n_failed)``; NULL summary on failure.

    ``error`` is the final call's, else the first failed chunk's; ``n_failed``
    counts chunks without a usable answer (SC25).

    Input: pairs ``(_id, team, content, variant)`` or documents
    ``(_id, team, content, _missing)`` with an array of variants to fill.

    Stage 1 makes one model call per (pair, chunk): the variant prompt when
    the text is one chunk, the generic part prompt otherwise.  Its output is
    materialised (checkpoint) so the branches below read it instead of
    re-chunking or re-calling the model.  Stage 2 makes the combine call for
    multi-chunk pairs over the ordered, non-empty partials.
    """
    from quire.session import cut_lineage

    if "_missing" not in pairs.columns:
        pairs = pairs.select("_id", "team", "content", F.array("variant").alias("_missing"))
    # chunk once per document, then fan out to its missing variants and chunks
    chunked = pairs.select("_id", "team", "_missing", chunk_array("content", chunk_tokens).alias("_chunks"))
    # explode_outer + a NULL filter: plain explode would make Catalyst infer a
    # size(_missing) > 0 filter that recomputes _missing below the projection;
    # so it is with the chunks
    per_variant = chunked.select("_id", "team", F.explode_outer("_missing").alias("variant"), "_chunks").filter(
        F.col("variant").isNotNull()
    )
    calls = per_variant.select(
        "_id", "variant", "team", F.size("_chunks").alias("_n"), F.posexplode_outer("_chunks").alias("_pos", "_chunk")
    ).filter(F.col("_pos").isNotNull())
    if model_partitions:
        # a remote model: fix the task count (AQE could coalesce a small input
        # into one task) - it is also the cap on concurrent calls
        calls = calls.repartition(model_partitions)
    single = F.col("_n") == 1
    system = F.when(single, F.lit(SYSTEM_SINGLE)).otherwise(F.lit(SYSTEM_PART))
    user = F.when(single, _prompt_for(F.col("variant"), F.col("team"), F.col("_chunk"))).otherwise(
        F.concat(fill_template(PART_PREFIX, team=F.col("team")), F.col("_chunk"))
    )
    out = _answered(calls, model, system, user).select("_id", "variant", "_n", "_pos", F.col("_answer.value").alias("_partial"), F.col("_answer.error").alias("_error"))
    if materialize:
        out = cut_lineage(out)
    failed = F.coalesce(F.col("_partial") == "", F.lit(True))
    done = out.filter(F.col("_n") == 1).select(
        "_id", "variant", F.col("_partial").alias("summary"), F.col("_error").alias("error"), F.lit(1).alias("n_chunks"), failed.cast("int").alias("n_failed")
    )
    # FL4 + AG6: failed (NULL or empty) partials are dropped, the rest joined in chunk order
    multi = (
        out.filter(F.col("_n") > 1)
        .groupBy("_id", "variant")
        .agg(
            F.array_sort(
                F.collect_list(F.when(~failed, F.struct("_pos", "_partial")))
            ).alias("_parts"),
            F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("_pos"))).alias("_first_error"),
            F.count(F.lit(1)).cast("int").alias("n_chunks"),
            F.sum(failed.cast("int")).cast("int").alias("n_failed"),
        )
        .withColumn("_combined", F.array_join(F.transform("_parts", lambda x: x["_partial"]), PART_SEPARATOR))
    )
    # if every chunk failed the combine call still runs, on ''
    combined = _answered(multi, model, F.lit(SYSTEM_COMBINE), F.concat(F.lit(COMBINE_PREFIX), F.col("_combined"))).select(
        "_id", "variant", F.col("_answer.value").alias("summary"), F.coalesce("_answer.error", "_first_error").alias("error"), "n_chunks", "n_failed"
    )
    # the combine calls are model output like the rest: made once, then read
    return done.unionByName(cut_lineage(combined) if materialize else combined)


def _answered(calls: DataFrame, model, system: Column, user: Column) -> DataFrame:
    """``calls`` with the model's ``_answer``; each variant has its own completion limit."""
    limits = sorted({cfg["max_tokens"] for cfg in VARIANTS.values()})
    if len(limits) == 1:
        return answered(calls, model, system, user, limits[0])
    of = {n: [v for v, cfg in VARIANTS.items() if cfg["max_tokens"] == n] for n in limits}
    parts = [answered(calls.where(F.col("variant").isin(names)), model, system, user, n) for n, names in of.items()]
    return reduce(DataFrame.unionByName, parts)


def fold_summaries(docs: DataFrame, new_rows: DataFrame) -> DataFrame:
    """AG7 + SNK3: merge new (variant -> summary) entries into each document's map.

    NULL and empty summaries are not written (the map is left as is).  Keys already
    present keep their value unless a new non-NULL value arrives
    (``map_zip_with`` instead of ``map_concat``, which rejects repeated keys).
    Returns ``docs`` with ``summaries`` updated and ``summaries_changed``.
    """
    fresh = (
        new_rows.filter(F.col("summary") != "")
        .groupBy("_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("variant", "summary"))).alias("_new"))
    )
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(
        F.coalesce(F.col("summaries"), empty), F.col("_new"), lambda k, old, new: F.coalesce(new, old)
    )
    out = docs.join(fresh, "_id", "left")
    return out.withColumn("summaries_changed", F.col("_new").isNotNull()).withColumn(
        "summaries", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("summaries"))
    ).drop("_new")


def incremental_summaries(
    docs: DataFrame, model, chunk_tokens: int = 100_000, materialize: bool = True, model_partitions: int | None = None
) -> DataFrame:
    """ML4 = JN3 + JN4 + ML3 + AG7: fill every missing summary, keep the rest.

    With ``materialize`` the output of the chunk calls and of the combine
    calls is checkpointed to the shared checkpoint folder, so a retried task
    or a second reader never calls the model for it again.
    """
    d = docs.filter(non_blank("content"))
    todo = F.filter(F.array(*[F.lit(v) for v in VARIANT_NAMES]), lambda v: ~non_blank(variant_lookup("summaries", v)))
    # documents with nothing missing drop out at the explode inside summarize
    work = d.select("_id", "team", "content", todo.alias("_missing"))
    new_rows = summarize(work, model, chunk_tokens, materialize, model_partitions)
    return fold_summaries(docs, new_rows)
