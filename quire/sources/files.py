"""File sources (SRC1, SRC2, SRC3, SRC7) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEAM_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

QA_SCHEMA = T.StructType([T.StructField("input", T.StringType()), T.StructField("expected_output", T.StringType())])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 + UN1: a team catalogue (JSON Lines, or one JSON document with a ``teams`` array) with each row's ``position``."""
    raw = spark.read.option("multiLine", True).json(path)
    if "teams" in raw.columns:
        wrapped = spark.read.schema(T.StructType([T.StructField("teams", T.ArrayType(TEAM_SCHEMA))])).option(
            "multiLine", True
        ).json(path)
        # files in the order of their scan, teams in that of their array
        place = (F.monotonically_increasing_id() * F.lit(1 << 24)).alias("file")
        return wrapped.select(place, F.posexplode("teams").alias("pos", "t")).select("t.*", (F.col("file") + F.col("pos")).alias("position"))
    return spark.read.schema(TEAM_SCHEMA).json(path).withColumn("position", F.monotonically_increasing_id())


def cached_articles(spark: SparkSession, directory: str) -> DataFrame:
    """SRC2: every file in ``directory`` read whole: ``(filename, content)``; names as they are on disk."""
    df = spark.read.text(directory, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # the path is percent-encoded; a plus sign in it is a plus sign
    return df.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("filename"), F.col("value").alias("content"))


def qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: ``{input, expected_output}`` pairs from JSON array files or JSON Lines (SNK5's own output).

    A question list is small: a file is read whole, and split into lines unless it holds an array.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    listed = F.when(F.col("value").rlike(r"\A\s*\["), F.from_json("value", T.ArrayType(QA_SCHEMA))).otherwise(F.transform(lines, lambda x: F.from_json(x, QA_SCHEMA)))
    return text.select(F.explode(listed).alias("q")).select("q.*")
