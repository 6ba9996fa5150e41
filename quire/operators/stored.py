"""Stored model outputs: each distinct prompt is answered once, over runs and retries (ML1, ML2, SC25, OB1).

Calls are named by a digest of the model's name, the limit and the prompt.  A
run asks the model only for digests that have no usable answer in the store,
each once however many calls share it, and appends the answers as Parquet;
everything after that reads the store, so a task that is retried, a second
reader or a later run never calls the model for them again.  Calls are made in
``waves`` (slices of the digests), each committed before the next: what a lost
job has answered stays answered.

Failed calls (after the retries of the model itself) are stored with their
error and the run that met them: that run returns the error, a later run asks
again.  The rows keep when each call began and ended, and its attempts, where
the model measures them; :func:`call_records` reads them as spans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import _c
from quire.sources.sinks import path_exists

_CALL = [T.StructField("attempts", T.IntegerType()), T.StructField("started", T.TimestampType()), T.StructField("ended", T.TimestampType())]


class _Store:
    """Answers under ``path``: ``(digest, value, error, attempts, started, ended, model, run)``."""

    def __init__(self, model, name: str, path: str, waves: int = 1):
        if waves < 1:
            raise ValueError("waves must be at least 1")
        self.model, self.name, self.path, self.waves = model, name, path, waves

    def _digest(self, *parts: Column) -> Column:
        # lengths keep parts apart; NULL is a part of its own
        named = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("null")) for p in (F.lit(self.name), *parts)]
        return F.sha2(F.concat(*named), 256)

    def _stored(self, spark: SparkSession, run: str | None = None) -> DataFrame:
        usable = F.col("error").isNull()
        return spark.read.schema(self.schema).parquet(self.path).where(usable | (F.col("run") == run) if run else usable)

    def _answered(self, calls: DataFrame, digest: Column, prompt: dict[str, Column], result: Column, column: str) -> DataFrame:
        """``calls`` with ``column``, a struct of value and error, read from the store."""
        spark, run = calls.sparkSession, uuid.uuid4().hex
        keyed = calls.withColumn("_digest", digest)
        prompts = keyed.select("_digest", *[c.alias(n) for n, c in prompt.items()]).dropDuplicates(["_digest"])
        for wave in range(self.waves):
            todo = prompts.where(F.pmod(F.xxhash64("_digest"), F.lit(self.waves)) == wave) if self.waves > 1 else prompts
            if path_exists(spark, self.path):
                todo = todo.join(self._stored(spark).select(F.col("digest").alias("_digest")), "_digest", "left_anti")
            done = todo.select(F.col("_digest").alias("digest"), result.alias("_r"))
            have = set(done.schema["_r"].dataType.names)
            fields = [F.col(f"_r.{f.name}") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[1:6]]
            done.select("digest", *fields, F.lit(self.name).alias("model"), F.lit(run).alias("run")).write.mode("append").parquet(self.path)
        answers = self._stored(spark, run).dropDuplicates(["digest"]).select(F.col("digest").alias("_digest"), F.struct("value", "error").alias(column))
        return keyed.join(answers, "_digest", "left").drop("_digest")


class StoredChat(_Store):
    """A chat model (anything with ``complete``) whose answers are stored under ``path``."""

    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType()), *_CALL, T.StructField("model", T.StringType()), T.StructField("run", T.StringType())])

    def answered(self, calls: DataFrame, system: Column | str, user: Column | str, max_tokens: int, column: str) -> DataFrame:
        limit = F.lit(max_tokens).cast("string")
        result = self.model.complete(F.col("_system"), F.col("_user"), max_tokens)
        return self._answered(calls, self._digest(limit, _c(system), _c(user)), {"_system": _c(system), "_user": _c(user)}, result, column)


class StoredEmbedder(_Store):
    """An embedder whose vectors are stored under ``path``; texts that fail have a NULL vector."""

    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType()), *_CALL, T.StructField("model", T.StringType()), T.StructField("run", T.StringType())])

    def embedded(self, rows: DataFrame, text: Column | str, column: str) -> DataFrame:
        embed = getattr(self.model, "embed_result", None)
        result = embed(F.col("_text")) if embed else F.struct(self.model.embed(F.col("_text")).alias("value"), F.lit(None).cast("string").alias("error"))
        out = self._answered(rows, self._digest(_c(text)), {"_text": _c(text)}, result, "_embedded")
        return out.withColumn(column, F.col("_embedded.value")).drop("_embedded")


def answered(calls: DataFrame, model, system: Column | str, user: Column | str, max_tokens: int = 1_500, column: str = "_answer") -> DataFrame:
    """``calls`` with the model's answer struct, through its store if it has one."""
    if hasattr(model, "answered"):
        return model.answered(calls, system, user, max_tokens, column)
    return calls.withColumn(column, model.complete(system, user, max_tokens))


def embedded(rows: DataFrame, embedder, text: Column | str, column: str = "embedding") -> DataFrame:
    """``rows`` with the vector of a text, through the embedder's store if it has one."""
    if hasattr(embedder, "embedded"):
        return embedder.embedded(rows, text, column)
    return rows.withColumn(column, embedder.embed(text))


def call_records(spark: SparkSession, path: str, name: str, parent_id: str | None = None) -> DataFrame:
    """OB1: one span per stored call, from its recorded times: ``trace_id, span_id, parent_id, name, start, end, status, error, attempts``."""
    return spark.read.parquet(path).select(
        F.col("run").alias("trace_id"),
        F.sha2(F.concat_ws("|", "run", "digest", F.lit(name)), 256).substr(1, 16).alias("span_id"),
        F.lit(parent_id).cast("string").alias("parent_id"),
        F.lit(name).alias("name"),
        F.col("started").alias("start"),
        F.col("ended").alias("end"),
        F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        "error",
        "attempts",
    )
