"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, bound: int) -> bool:
    """True when ``df`` has at most ``bound`` rows; reads at most ``bound + 1`` rows."""
    return df.limit(bound + 1).count() <= bound


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when its row count is proven ``<= max_rows``.

    Otherwise the plain DataFrame is returned and the planner uses a shuffle
    join (AQE may still convert it at run time, and splits skewed partitions).
    """
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join in which NULL keys are equal; the result keeps the left side's key columns."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """TK6: keys that occur more than once (aggregated map-side; empty when unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise when ``keys`` is not unique in ``df`` (reads one duplicate at most)."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"key {keys} is not unique: {dup[0].asDict()}")
