"""Observability as tables (OB1, OB2, OB3, SNK8).

Spans: every model call row becomes one span row (trace = the work item,
parent = the job span), with status taken from the call's error column.
Experiments: one row per evaluation run with its configuration as a struct.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def call_spans(
    calls: DataFrame, name: str, trace_cols: Sequence[str], parent_id=None, error_col: str | None = None
) -> DataFrame:
    """OB1: one span per model call row.

    ``span_id`` is the first 16 hex digits of sha256(``trace|name``), so a
    re-run writes the same ids; ``parent_id`` is a literal, a Column or NULL.
    """
    from pyspark.sql import Column

    trace = F.concat_ws(":", *[F.col(c).cast("string") for c in trace_cols])
    err = F.col(error_col) if error_col else F.lit(None).cast("string")
    now = F.current_timestamp()
    parent = parent_id if isinstance(parent_id, Column) else F.lit(parent_id).cast("string")
    return calls.select(
        trace.alias("trace_id"),
        F.sha2(F.concat_ws("|", trace, F.lit(name)), 256).substr(1, 16).alias("span_id"),
        parent.alias("parent_id"),
        F.lit(name).alias("name"),
        now.alias("start"),
        now.alias("end"),
        F.when(err.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        err.alias("error"),
    )


def traced_spans(
    calls: DataFrame, root: str, steps: Sequence[str], trace_cols: Sequence[str], error_col: str | None = None
) -> DataFrame:
    """OB1 for a traced pipeline: one root span plus one child span per step, per row, in one pass."""
    trace = F.concat_ws(":", *[F.col(c).cast("string") for c in trace_cols])
    root_id = F.sha2(F.concat_ws("|", trace, F.lit(root)), 256).substr(1, 16)
    err = F.col(error_col) if error_col else F.lit(None).cast("string")
    entries = [F.struct(F.lit(root).alias("name"), F.lit(None).cast("string").alias("parent_id"))] + [
        F.struct(F.lit(s).alias("name"), root_id.alias("parent_id")) for s in steps
    ]
    now = F.current_timestamp()
    e = calls.select(trace.alias("trace_id"), err.alias("error"), F.explode(F.array(*entries)).alias("_s"))
    return e.select(
        "trace_id",
        F.sha2(F.concat_ws("|", F.col("trace_id"), F.col("_s.name")), 256).substr(1, 16).alias("span_id"),
        F.col("_s.parent_id").alias("parent_id"),
        F.col("_s.name").alias("name"),
        now.alias("start"),
        now.alias("end"),
        F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        "error",
    )


def experiment_row(spark: SparkSession, name: str, config: dict) -> DataFrame:
    """OB2: one-row experiment record; ``config`` is kept as JSON text."""
    text = json.dumps(config, sort_keys=True)
    df = spark.createDataFrame([(name, text)], "name string, config_json string")
    return df.select("name", F.current_timestamp().alias("started"), "config_json")

