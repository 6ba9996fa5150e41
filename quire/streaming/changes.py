"""Change detection as a stateful stream (section 2.12 of the survey, JN2, JN4, JN5).

* :func:`changed_versions`: the state store holds, per key, the digest of the
  current content and the last number seen - no text.  A version is emitted if
  its key is new or its content differs from the current one.  Versions come in
  number order within a micro-batch; numbers not above the last one seen are
  replays and are passed over, so a file dropped twice changes nothing.
* :func:`run_change_stream` writes these into a bucketed table
  (:mod:`quire.sources.buckets`): only buckets with changed keys are replaced.
  Texts never pass through Python: changed versions name their file, and the
  sink joins these files' rows by key and number.  A micro-batch that is
  processed again merges the same rows, so the sink is idempotent.
* :func:`new_vector_rows` and :func:`new_missing_pairs`: the incremental anti
  joins as streams; their state holds keys and digests only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.joins import join_same
from quire.operators.summaries import missing_pairs
from quire.operators.vectors import VECTOR_KEYS, summary_rows
from quire.session import cut_lineage
from quire.sources import buckets

STATE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("last", T.LongType())])


def changed_versions(versions: DataFrame, keys: Sequence[str], seq: str = "seq", content: str = "content") -> DataFrame:
    """Streaming ``(keys, seq, action, file)`` of the versions that insert or update their key.

    ``versions`` is a stream of files; ``seq`` grows within a key (rows without one take no part, and of
    equal numbers the first seen counts).  A NULL content is a content like any other.
    """
    keys = list(keys)
    digest = F.coalesce(F.sha2(F.col(content), 256), F.lit("null"))
    rows = versions.where(F.col(seq).isNotNull()).select(*keys, F.col(seq).cast("long").alias(seq), digest.alias("digest"), F.col("_metadata.file_path").alias("file"))
    out = T.StructType([*(versions.schema[k] for k in keys), T.StructField(seq, T.LongType()), T.StructField("action", T.StringType()), T.StructField("file", T.StringType())])

    def detect(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, last = state.get if state.exists else (None, None)
        got = pd.concat(list(parts)).sort_values(seq, kind="stable")
        emitted = []
        for number, found, file in zip(got[seq], got["digest"], got["file"]):
            if last is not None and number <= last:
                continue
            if found != current:
                emitted.append((*key, number, "inserted" if current is None else "updated", file))
            current, last = found, number
        state.update((current, int(last)))
        yield pd.DataFrame(emitted, columns=out.names)

    return rows.groupBy(*keys).applyInPandasWithState(detect, out, STATE, "append", GroupStateTimeout.NoTimeout)


def _merge(spark: SparkSession, changed: DataFrame, schema: T.StructType, table: str, keys: list[str], seq: str, n_buckets: int) -> None:
    """Write the last changed version of each key of a micro-batch into the table."""
    changed = cut_lineage(changed)
    files = [unquote(r.file) for r in changed.select("file").distinct().collect()]  # the files of one micro-batch
    if not files:
        return
    last = changed.groupBy(*keys).agg(F.max(seq).alias(seq))
    rows = spark.read.schema(schema).parquet(*files).withColumn(seq, F.col(seq).cast("long"))
    rows = join_same(rows, last, [*keys, seq], "left_semi").dropDuplicates([*keys, seq]).drop(seq)
    if not buckets.create(rows, table, keys, n_buckets):
        buckets.update(spark, table, rows)


def run_change_stream(
    spark: SparkSession, source: str, schema: T.StructType, table: str, checkpoint: str, keys: Sequence[str], seq: str = "seq", content: str = "content", n_buckets: int = 64, max_files: int = 1_000
) -> None:
    """Process all version files present in ``source`` and stop; ``max_files`` bounds a micro-batch."""
    keys = list(keys)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    changes = changed_versions(stream, keys, seq, content)
    query = (
        changes.writeStream.outputMode("append")
        .foreachBatch(lambda batch, _: _merge(spark, batch, schema, table, keys, seq, n_buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def new_vector_rows(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """JN5 as a stream: summary rows of a stream of documents whose (team, summary_type) has no stored vector and was not seen before.

    The state holds keys; of rows with one key in a micro-batch one is kept.
    """
    have = stored.select(*VECTOR_KEYS).distinct()
    return summary_rows(docs).join(have, VECTOR_KEYS, "left_anti").dropDuplicates(VECTOR_KEYS)


def new_missing_pairs(docs: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """JN4 as a stream: (document, variant, content) that still needs a summary, each content once."""
    pairs = missing_pairs(docs, variants).withColumn("digest", F.sha2("content", 256))
    return pairs.dropDuplicates(["_id", "variant", "digest"]).drop("digest")
