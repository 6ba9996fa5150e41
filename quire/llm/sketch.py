"""A Bloom filter of fixed size over the long values of a column, built by Spark.

``2**24`` bits are two megabytes whatever the table's size, which bounds the
broadcast.  A filter that fills up lets more rows through; it never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import mix

BITS = 24
PROBES = 2


def _probes(values: np.ndarray) -> list[np.ndarray]:
    return [mix(values ^ np.uint64(k)) >> np.uint64(64 - BITS) for k in range(PROBES)]


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """The filter's 64-bit words: set in tasks, joined by bitwise or; at most ``2**18`` rows reach the driver."""

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 6), np.uint64)
        for part in parts:
            values = np.asarray(part.column(0).drop_null(), np.int64).view(np.uint64)
            for at in _probes(values):
                np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        words = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits[words].view(np.int64))], ["word", "mask"])

    found = df.select(F.col(column).cast("long")).mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in found.collect():
        out[r.word] = r.mask
    return out.view(np.uint64)


def contains(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the uint64 values may be in the filter."""
    out = np.ones(len(values), bool)
    for at in _probes(values):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def packed_bloom(df: DataFrame, column: str, parts: int = 64) -> np.ndarray:
    """The same filter, its parts joined in tasks: ``parts`` rows reach the driver."""
    size = (1 << (BITS - 6)) // parts

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((parts, size), np.uint64)
        for some in rows:
            values = np.asarray(some.column(0).drop_null(), np.int64).view(np.uint64)
            for at in _probes(values):
                np.bitwise_or.at(bits.ravel(), at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(bits.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([bits[k].tobytes() for k in used], pa.binary())], ["part", "bits"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in rows["bits"]])
        return pd.DataFrame([(key[0], bits.tobytes())], columns=["part", "bits"])

    found = df.select(F.col(column).cast("long")).mapInArrow(mark, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary")
    out = np.zeros((parts, size), np.uint64)
    for r in found.collect():
        out[r.part] = np.frombuffer(r.bits, np.uint64)
    return out.ravel()
