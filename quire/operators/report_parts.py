"""Evaluation reports merged over runs from stored partial results (AG2, AG3, OB3).

A run's part holds, per summary type, what merges: counts and sums of every
score, the best and worst item, a distinct-count sketch of the teams and a
quantile sketch of the combined score.  Parts are small (a row a type), so a
report over any number of runs reads no items again.

Means, counts, best and worst are exact; ``n_teams`` and the quantiles are
estimates of the sketches.  Runs hold different items: an item that two runs
score counts in both.  A run stored again replaces its part, also by a run
without items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.evaluate import best_worst_rows, report_line

SCORES = ["bert_f1", "cosine_similarity", "combined_score"]
QUANTILES = (0.1, 0.5, 0.9)
#: sizes of the sketches: 2^12 registers (about 1.6 % error), k = 200 (about 1.65 % of the rank)
TEAM_REGISTERS = 12
QUANTILE_K = 200

_ROW = "struct<team: string, summary_type: string, combined_score: double, item_id: string>"
PART_SCHEMA = ", ".join(
    ["summary_type string", "n_items long", *[f"{c}_n long, {c}_sum double" for c in SCORES], f"best {_ROW}", f"worst {_ROW}", "teams binary", "combined binary", "run string"]
)


def report_part(wide: DataFrame, run: str) -> DataFrame:
    """The part of one run: a row per summary type (NULL is one) and a row without items, so that no part is empty."""
    row = F.struct("team", "summary_type", "combined_score", "item_id")
    scored = F.col("combined_score").isNotNull()
    part = wide.groupBy("summary_type").agg(
        F.count(F.lit(1)).alias("n_items"),
        *[f for c in SCORES for f in (F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_sum"))],
        # rows whose order is NULL are passed over
        F.min_by(row, F.when(scored, F.struct(-F.col("combined_score"), F.col("item_id")))).alias("best"),
        F.min_by(row, F.when(scored, F.struct(F.col("combined_score"), F.col("item_id")))).alias("worst"),
        F.hll_sketch_agg("team", F.lit(TEAM_REGISTERS)).alias("teams"),
        F.kll_sketch_agg_double("combined_score", F.lit(QUANTILE_K)).alias("combined"),
    )
    marker = wide.sparkSession.createDataFrame([(0,)], "n_items long")
    return part.unionByName(marker, allowMissingColumns=True).withColumn("run", F.lit(run))


def store_part(wide: DataFrame, path: str, run: str) -> None:
    """Writes the run's part under ``path``; a part of the same run is replaced, other runs stay."""
    part = report_part(wide, run)
    part.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_parts(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """Stored parts, of all runs or only of those named (other folders are not read)."""
    parts = spark.read.schema(PART_SCHEMA).parquet(path)
    return parts if runs is None else parts.where(F.col("run").isin(list(runs)))


def merged_report(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AG2 + OB3 over all parts: ``evaluate.type_report``'s columns, ``n_items``, ``n_teams`` and quantiles.

    ``by=["run"]`` reports each run on its own, to follow scores over runs.
    """
    merged = (
        parts.where(F.col("summary_type").isNotNull())
        .groupBy(*by, "summary_type")
        .agg(
            *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in SCORES],
            F.sum("n_items").alias("n_items"),
            F.hll_sketch_estimate(F.hll_union_agg("teams")).alias("n_teams"),
            F.sum("combined_score_n").alias("_n"),
            F.kll_merge_agg_double("combined").alias("_sketch"),
        )
    )
    quantiles = [F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(q))).alias(f"combined_p{round(100 * q)}") for q in QUANTILES]
    return merged.select(*by, "summary_type", *SCORES, report_line().alias("line"), "n_items", "n_teams", *quantiles).orderBy("summary_type", *by)


def merged_best_worst(parts: DataFrame) -> DataFrame:
    """AG3 over all parts: the rows of ``evaluate.best_worst``."""
    score, item = F.col("best.combined_score"), F.col("best.item_id")
    low, low_item = F.col("worst.combined_score"), F.col("worst.item_id")
    ends = parts.agg(
        (F.min("worst.combined_score") < F.max("best.combined_score")).alias("varies"),
        F.min_by("best", F.when(score.isNotNull(), F.struct(-score, item))).alias("best"),
        F.min_by("worst", F.when(low.isNotNull(), F.struct(low, low_item))).alias("worst"),
    )
    return best_worst_rows(ends)
