"""Catalogue tables laid out by key: joins on it do not move the stored rows (JN4, JN5, SNK4, SNK9).

A table is stored in hash buckets of its key columns.  A join on these columns
exchanges only the other side, to the table's buckets, so the cost of an
incremental anti join follows the new rows.  (Give at least
``spark.sql.shuffle.partitions`` buckets, or Spark prefers to move both sides.)

The layout and the table's properties are stored beside the rows, so a session
whose catalogue does not know the table attaches it by its folder.  A vector
table's contract (column and size) is among the properties and is enforced on
every append: rows that break it go to the quarantine folder with the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vectors import contract_violation
from quire.session import cut_lineage
from quire.sources.sinks import path_exists

#: properties of a table whose rows hold a vector
VECTOR_COLUMN, VECTOR_SIZE = "quire.vector.column", "quire.vector.size"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _layout(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}_layout").first()


def attach(spark: SparkSession, name: str, path: str) -> None:
    """Make a stored table known to the session's catalogue; nothing to do if it is."""
    if spark.catalog.tableExists(name):
        return
    row = _layout(spark, path)
    keys = ", ".join(f"`{k}`" for k in row["keys"])
    properties = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in sorted(row["properties"].items()))
    spark.sql(
        f"CREATE TABLE {name} ({row['columns']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {row['buckets']} BUCKETS "
        f"LOCATION {_quoted(path)}" + (f" TBLPROPERTIES ({properties})" if properties else "")
    )


def create_if_absent(rows: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, properties: dict[str, str] | None = None) -> bool:
    """Store ``rows`` as table ``name`` under ``path``; if the table is there, only attach it and return False."""
    spark = rows.sparkSession
    if path_exists(spark, f"{path}_layout"):
        attach(spark, name, path)
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # one writing task a bucket: a bucket is one file until rows are appended
    rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    if properties:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f'{_quoted(k)} = {_quoted(v)}' for k, v in sorted(properties.items()))})")
    layout = [(list(keys), buckets, columns, properties or {})]
    # written last: a table without a layout is not there yet
    spark.createDataFrame(layout, "keys array<string>, buckets int, columns string, properties map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{path}_layout")
    return True


def create_vector_table(spark: SparkSession, name: str, path: str, columns: str, keys: Sequence[str], buckets: int, vector: str, size: int) -> bool:
    """SNK9: an empty vector table with its contract, unless there is one already."""
    return create_if_absent(spark.createDataFrame([], columns), name, path, keys, buckets, {VECTOR_COLUMN: vector, VECTOR_SIZE: str(size)})


def append(rows: DataFrame, name: str, path: str) -> tuple[int, int]:
    """SNK4 + SNK9: append rows that meet the stored contract, quarantine the others; returns how many of each."""
    spark = rows.sparkSession
    attach(spark, name, path)
    layout = _layout(spark, path)
    keys, buckets, contract = list(layout["keys"]), layout["buckets"], layout["properties"]
    columns = spark.table(name).columns
    rows = rows.select(*columns)
    if VECTOR_COLUMN in contract:
        # written once: an embedder runs once though two outputs are made of its rows
        rows = cut_lineage(rows.withColumn("violation", contract_violation(contract[VECTOR_COLUMN], int(contract[VECTOR_SIZE]))))
    else:
        rows = cut_lineage(rows.withColumn("violation", F.lit(None).cast("string")))
    good, bad = rows.where("violation IS NULL").drop("violation"), rows.where("violation IS NOT NULL")
    counts = rows.agg(F.count(F.when(F.col("violation").isNull(), 1)), F.count("violation")).first()
    if counts[0]:
        good.repartition(buckets, *keys).write.mode("append").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    if counts[1]:
        bad.write.mode("append").parquet(f"{path}_quarantine")
    return counts[0], counts[1]
