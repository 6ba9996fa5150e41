"""Corpus pipeline: five stages over ``documents``, each one operator of ``quire.llm``.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs`` as they came: extra columns, whatever their names, travel
in one struct while an operator adds its own.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard, langid, packing, pii
from quire.llm.queries import table, tokenizer_path
from quire.session import ensure_checkpoint_dir

#: a document whose language is less sure than this goes
LEAST_LANGUAGE = 0.1


def _rows(docs: DataFrame) -> DataFrame:
    """``__row``, the whole row, beside its ``text``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (or text), and those of no recognised language.

    The languages are those of ``docs.lang``; a text that costs more under the nearest of them
    than under none (see ``langid``) is of no recognised language.
    """
    judged = langid.predict(_rows(docs), langid.train(docs), keep=("__row",), reject=True)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id in each group of texts linked at 0.8 on five-word shingles.

    Rows that repeat an id and its text are one document; rows without an id stay.
    """
    groups = jaccard.jaccard_components(docs, n=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whole or edited.

    A document is its id and text: rows without an id go like others, and a clean text stays
    though another of the same id goes.
    """
    keyed = _rows(docs).withColumn("__key", F.xxhash64(F.col("__row.doc_id").isNull(), "__row.doc_id", "text"))
    hits = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(hits, "__key", "left_anti").select("__row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets in place of each personal-data span; ``n_chars`` follows the text."""
    found = pii.detect(_rows(docs)).withColumn("__new", pii.masked(F.col("text"), "spans"))
    new = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("__new").cast("long")).otherwise(F.col("__row.n_chars"))
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: No stage can be written whole in SQL (trained models, alignment, tokenizer): see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; results between them go to the shared checkpoint folder."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
