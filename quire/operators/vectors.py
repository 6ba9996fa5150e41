"""Summary-vector load and contract (UN3, JN5, ML1, PR5, PR8, SNK4, SNK9).

Only (team, summary_type) pairs not yet in the vector table are embedded.
Like the reference, duplicates inside one batch are all kept (the lookup sees
only committed rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.vectors import contract_violation
from quire.operators.stored import embedded

VECTOR_KEYS = ["team", "summary_type"]


def summary_rows(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """UN3 + PR8: one row per (document, summary entry); every map key is kept.

    ``carry`` names extra document columns to keep (e.g. the document id).
    """
    empty = F.create_map().cast("map<string,string>")
    return docs.select(
        *(carry or []),
        "team",
        "source_url",
        F.coalesce(F.col("metadata"), empty).alias("metadata"),
        "timestamp",
        F.explode(F.coalesce(F.col("summaries"), empty)).alias("summary_type", "summary_text"),
    )


def missing_vectors(docs: DataFrame, vectors: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """JN5: summary rows whose (team, summary_type) has no stored vector."""
    have = vectors.select(*VECTOR_KEYS).distinct()
    return summary_rows(docs, carry).join(have, VECTOR_KEYS, "left_anti")


def build_vector_rows(rows: DataFrame, embedder) -> DataFrame:
    """ML1 + PR5: embed the summary text and carry source_url, metadata, timestamp."""
    return embedded(rows, embedder, "summary_text").select(
        *VECTOR_KEYS,
        "summary_text",
        "embedding",
        "source_url",
        "metadata",
        "timestamp",
    )


def check_contract(vectors: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """SNK9: adds ``violation`` (NULL when the vector meets size/non-null/norm rules)."""
    return vectors.withColumn("violation", contract_violation(vec_col, dim))


def append_vectors(new_rows: DataFrame, path: str, dim: int) -> None:
    """SNK4 + SNK9: append valid rows, quarantine the rest next to the table.

    The embedded rows are checkpointed to the shared folder first, so the
    (possibly remote, non-deterministic) embedder runs once even though two
    outputs are written.
    """
    from quire.session import cut_lineage

    checked = cut_lineage(check_contract(new_rows, dim))
    checked.filter(F.col("violation").isNull()).drop("violation").write.mode("append").parquet(path)
    checked.filter(F.col("violation").isNotNull()).write.mode("append").parquet(path.rstrip("/") + "_quarantine")
