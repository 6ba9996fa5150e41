"""Sinks (SNK1-SNK8): snapshot tables, appends and exports.

No table format with MERGE is available here, so keyed updates (SNK2, SNK3)
write a new snapshot directory and leave the previous one intact; readers
switch to the new path once the write has committed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import iso_timestamp, stamp_name


def path_exists(spark, path: str) -> bool:
    """Whether a file or folder is there, by the path's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_articles(df: DataFrame, path: str, export_text_dir: str | None = None) -> None:
    """SNK1: assembled articles as Parquet; optional one-text-per-team export."""
    df.write.mode("overwrite").parquet(path)
    if export_text_dir:
        df.select("team", "article").write.mode("overwrite").partitionBy("team").text(export_text_dir)


def write_snapshot(df: DataFrame, path: str) -> None:
    """SNK2/SNK3: write the new snapshot (a fresh directory per run)."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK4: batched append; an empty DataFrame appends no rows."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_qa_json(df: DataFrame, path: str) -> None:
    """SNK5: QA pairs as JSON Lines, UTF-8 kept, overwrite."""
    df.select("input", "expected_output").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_qa_json_array(df: DataFrame, path: str, position: str | None = None) -> None:
    """SNK5: QA pairs as one indented JSON array, UTF-8 kept, in the order of ``position`` (default: of the rows).

    The folder holds one file, written by one task that reads its lines sorted; an empty set is an empty array.
    """
    from quire.session import cut_lineage

    def value(c: str) -> Column:
        boxed = F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})  # {"v":...}
        return F.substr(boxed, F.lit(6), F.length(boxed) - 6)

    place = F.col(position).cast("long") if position else F.monotonically_increasing_id()
    # written once: the last row is looked up before the lines are made
    rows = cut_lineage(df.select(place.alias("place"), *[value(c).alias(c) for c in ("input", "expected_output")]))
    last = rows.agg(F.max("place")).first()[0]
    item = F.concat(
        F.lit('  {\n    "input": '), F.col("input"), F.lit(',\n    "expected_output": '), F.col("expected_output"),
        F.when(F.col("place") < F.lit(last), F.lit("\n  },")).otherwise(F.lit("\n  }")),
    )
    bounds = df.sparkSession.createDataFrame([(0, None, "["), (2, None, "]")], "section int, place long, value string")
    lines = bounds.unionByName(rows.select(F.lit(1).alias("section"), "place", item.alias("value")))
    lines.repartition(1).sortWithinPartitions("section", "place").select("value").write.mode("overwrite").text(path)


def append_eval_set(df: DataFrame, path: str, prefix: str, run_ts: Column | None = None) -> None:
    """SNK6: items appended under a timestamped dataset name (partition column)."""
    ts = run_ts if run_ts is not None else F.current_timestamp()
    df.withColumn("dataset_name", stamp_name(prefix, ts)).write.mode("append").partitionBy("dataset_name").parquet(path)


def append_new_rows(spark, df: DataFrame, path: str, key_cols: list[str]) -> DataFrame:
    """SNK7: get-or-create a named set; rows already present (same key) are not appended again.

    NULL keys are keys like any other, and of rows of one batch with the same
    key one is appended.  Only a missing folder means "no set yet": any other
    error in reading it is raised.
    """
    from quire.session import cut_lineage

    fresh = df.dropDuplicates(key_cols)
    if path_exists(spark, path):
        existing = spark.read.parquet(path).select(*[F.col(c).alias(f"_{c}") for c in key_cols]).distinct()
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key_cols])
        fresh = fresh.join(existing, same, "left_anti")
    # materialise before writing: the anti-join must not be re-evaluated
    # against the table it is appending to
    fresh = cut_lineage(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh


def append_experiment(experiment: DataFrame, scores: DataFrame, path: str) -> None:
    """SNK8: one experiment row and its score rows, appended under ``path``.

    ``experiment`` is one row (``observe.experiment_row``); every score row carries its name.  The name is the
    experiment's key: a second run of it replaces its scores and adds no second row.  The row is written
    after the scores, so an experiment that is listed has them.
    """
    spark = experiment.sparkSession
    name, listed = experiment.first()["name"], f"{path}/experiments"
    named = scores.withColumn("experiment", F.lit(name))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(f"{path}/scores")
    if not path_exists(spark, listed) or spark.read.parquet(listed).where(F.col("name") == name).isEmpty():
        experiment.write.mode("append").parquet(listed)


def export_iso(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """SC14 at export time: ISO-8601 timestamps as text."""
    return df.withColumn(ts_col, iso_timestamp(ts_col))
