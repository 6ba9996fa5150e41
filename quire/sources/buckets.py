"""Keyed tables in hash buckets: updates rewrite only the buckets that hold changed keys (SNK2, SNK3).

Plain Parquet has no MERGE.  A keyed table here is a folder of Parquet files
partitioned by ``bucket``, a hash of its key modulo a fixed count that is stored
beside the rows.  An update reads the buckets of its keys (by partition
pruning), merges them and replaces just these folders by dynamic partition
overwrite; all other files stay as they are.

Spark stages the new files and moves them in when the job commits, so a failed
job leaves the old rows.  An update that is made again gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.joins import join_same
from quire.session import cut_lineage
from quire.sources.sinks import path_exists

BUCKET = "bucket"
#: bounds the folders of a table and the bucket numbers that reach the driver
MAX_BUCKETS = 1 << 16


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row: equal for equal keys, NULL keys included."""
    # a NULL leaves a hash as it is, so whether a key is NULL is hashed too
    return F.pmod(F.xxhash64(*[c for k in keys for c in (F.col(k).isNull(), F.col(k))]), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/layout")


def layout(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(keys, buckets) of a stored table."""
    row = spark.read.parquet(f"{path}/layout").first()
    return list(row["keys"]), row["buckets"]


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> bool:
    """Store ``rows`` (one per key) as a new table; False, and nothing written, if there is one already."""
    spark = rows.sparkSession
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MAX_BUCKETS}")
    if BUCKET in rows.columns:
        raise ValueError(f"{BUCKET} is the column of the table's layout")
    if exists(spark, path):
        return False
    placed = rows.withColumn(BUCKET, bucket_of(keys, buckets))
    # one task a bucket, large buckets split: no folder gets a file from every task
    placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows")
    # written last: a table without a layout is not there yet
    spark.createDataFrame([(list(keys), buckets)], "keys array<string>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return True


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop(BUCKET)


def update(spark: SparkSession, path: str, rows: DataFrame, insert: bool = True) -> list[int]:
    """Merge ``rows`` (the key columns and any others, one row per key) into the table; returns the buckets replaced.

    Columns that ``rows`` does not carry keep their stored value (NULL for new keys).  With ``insert=False``
    keys that are not stored are left out.
    """
    keys, buckets = layout(spark, path)
    # read twice below, and its keys decide which folders are replaced
    placed = cut_lineage(rows.withColumn(BUCKET, bucket_of(keys, buckets)))
    touched = sorted(r[BUCKET] for r in placed.select(BUCKET).distinct().collect())  # at most MAX_BUCKETS numbers
    if not touched:
        return []
    stored = _stored(spark, path)
    old = stored.where(F.col(BUCKET).isin(touched))
    same = [BUCKET, *keys]
    left = [c for c in stored.columns if c not in rows.columns and c != BUCKET]
    kept = join_same(old, placed.select(*same), same, "left_anti")
    changed = join_same(placed, old.select(*same, *left), same, "left" if insert else "inner")
    merged = kept.unionByName(changed.select(*[F.col(c).cast(stored.schema[c].dataType) for c in stored.columns]))
    merged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/rows")
    return touched


def upsert_into(spark: SparkSession, path: str, batch: DataFrame, seq: str = "seq", block_size: int = 100_000) -> tuple[DataFrame, list[int]]:
    """JN2 into a stored table: ``(actions, buckets replaced)``.

    The change detection of :func:`quire.operators.ingest.upsert` over the digests of the batch's buckets;
    only the winning versions of changed keys reach the table.
    """
    from quire.operators.ingest import mark_versions, reject_ties

    keys, buckets = layout(spark, path)
    touched = [r[BUCKET] for r in batch.select(bucket_of(keys, buckets).alias(BUCKET)).distinct().collect()]
    stored = _stored(spark, path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    marked = reject_ties(cut_lineage(mark_versions(stored, batch, keys, seq, block_size)), keys, seq)
    final = marked.where("_applied").groupBy(*keys).agg(F.max_by("_seq", "_ord").alias(seq)).where(F.col(seq).isNotNull())
    winners = join_same(batch.withColumn(seq, F.col(seq).cast("long")), final, [*keys, seq]).drop(seq)
    replaced = update(spark, path, winners)
    return marked.where("action IS NOT NULL").select(*keys, F.col("_seq").alias(seq), "action"), replaced
