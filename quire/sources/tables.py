"""Explicit schemas and readers for the corpus tables (SRC4, SRC5, SRC6, SRC8).

Production reads never infer a schema: every reader passes the StructType so
Parquet column pruning and filter pushdown see exactly the requested fields.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    ),
    "pages": T.StructType(
        [
            T.StructField("page_id", T.LongType()),
            T.StructField("url", T.StringType()),
            T.StructField("html", T.StringType()),
        ]
    ),
    "embeddings": T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("label", T.IntegerType()),
        ]
    ),
    "benchmark": T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]),
    "labels": T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("quality", T.IntegerType()),
            T.StructField("toxic", T.IntegerType()),
        ]
    ),
    "conversations": T.StructType(
        [
            T.StructField("conv_id", T.LongType()),
            T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    ),
    "events": T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    ),
}


# Row key of each table: used to spread an under-partitioned scan.
KEYS = {
    "documents": "doc_id",
    "pages": "page_id",
    "embeddings": "vec_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": "conv_id",
    "events": "event_id",
}


# A scan with fewer partitions than this (and than the cluster's cores) is spread.
SPREAD_BELOW = 64


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Hash-partition an under-partitioned scan over the cluster's cores.

    A table stored as one large row group scans as a single task, so all
    per-row text work would run on one core.  Only scans with fewer
    partitions than both the core count and ``SPREAD_BELOW`` are touched, so
    the extra shuffle is bounded by a small table; a large table on a cluster
    already scans as many splits and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n >= min(cores, SPREAD_BELOW):
        return df
    target = 2 * cores  # two tasks per core even out uneven text lengths
    return df.repartition(target, key) if key else df.repartition(target)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str, spread_rows: bool = True) -> DataFrame:
    """SRC5/SRC6: full or projected scan of one corpus table (pruned to ``columns``).

    ``spread_rows=False`` for scans that feed a shuffle (join, aggregate) right
    away: the shuffle itself spreads the rows.
    """
    df = spark.read.schema(SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if columns:
        df = df.select(*columns)
    if not spread_rows:
        return df
    key = KEYS.get(name)
    return spread(df, key if key in df.columns else None)


def documents(spark: SparkSession, sf_dir: str, *columns: str, spread_rows: bool = True) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *columns, spread_rows=spread_rows)


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """SRC4: page HTML table ``(page_id, url, html)``."""
    return read_table(spark, sf_dir, "pages", *columns)


def embeddings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", *columns)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: the question list; the ``benchmark`` table stands in for it."""
    return read_table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")
