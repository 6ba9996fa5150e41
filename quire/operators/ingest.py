"""Collection and change-detecting upsert (SRC1, SRC2, JN1, FL1, SO1, PR2, PR3, JN2, WN1, AG9).

Upsert semantics (sequential, per key, in ``seq`` order): a version whose key
is unknown is inserted; a version whose content differs from the current
content replaces every field it carries (stored-only fields such as
``summaries`` survive); an equal content is a no-op, even when timestamp or
metadata changed.  Because a no-op leaves the content equal to the version's
own content, "applied" is simply ``content`` differing from the previous
version's content - a lag.

Scale: the lag is taken inside ``(key, seq block)`` windows and the first row
of each block looks up the last content of the previous block from a small
per-block table, so a hot key with a third of all rows is spread over many
tasks instead of one.  The final state per key is a ``max_by`` aggregate,
which Spark combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import iso_timestamp
from quire.operators.joins import assert_unique, broadcast_if_small, join_same
from quire.session import cut_lineage

DEFAULT_KEYS = ("team", "source_url")
# Distinct batch keys are broadcast only below this many rows (about 10 MB of
# short string keys); larger batches use shuffle joins with AQE skew handling.
BATCH_KEYS_BROADCAST_ROWS = 100_000


def crawled_rows(df: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """PR2: stamp one run timestamp and default the metadata to an empty map."""
    ts = run_ts if run_ts is not None else F.current_timestamp()
    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    return df.withColumn("timestamp", ts).withColumn("metadata", meta)


def split_cached(catalogue: DataFrame, files: DataFrame, on: str = "filename") -> tuple[DataFrame, DataFrame]:
    """JN1: catalogue rows with a cached file (semi) and without one (anti)."""
    present = files.select(on).distinct()
    return catalogue.join(present, on, "left_semi"), catalogue.join(present, on, "left_anti")


def collect_documents(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """SO1 + FL1 + S7: cached rows keep '' content; fetched rows need content."""
    cached = cached.withColumn("content", F.coalesce(F.col("content"), F.lit("")))
    fetched = fetched.filter(F.length("content") > 0)
    return cached.unionByName(fetched)


def parse_projection(df: DataFrame, *keep: str) -> DataFrame:
    """PR3: url -> source_url, drop filename; ISO timestamp only at export (SC14).  ``keep`` names more columns."""
    return df.select(
        "team", F.col("url").alias("source_url"), "content", "timestamp", "metadata", *keep
    )


def export_projection(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", iso_timestamp("timestamp"))


def _versions(stored: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """All versions as ``(keys, _stored, _seq, _ord, _digest)``: no text crosses a window."""
    digest = F.sha2("content", 256).alias("_digest")
    s = stored.select(*keys, F.lit(True).alias("_stored"), F.lit(None).cast("long").alias("_seq"), digest)
    b = batch.select(*keys, F.lit(False).alias("_stored"), F.col(seq).cast("long").alias("_seq"), digest)
    # stored rows sort before every batch row of their key
    return s.unionByName(b).withColumn("_ord", F.coalesce(F.col("_seq"), F.lit(-(2**62))))


def mark_versions(
    stored: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    seq: str = "seq",
    block_size: int = 100_000,
    batch_keys: DataFrame | None = None,
) -> DataFrame:
    """WN1: every version of an affected key with ``_applied`` and ``action``.

    ``action`` is ``inserted``/``updated``/``unchanged`` for batch rows and NULL
    for the stored row.  ``seq`` must be unique within a key: ``_tied`` marks batch
    rows without one, and those whose number another row of the key has.  Contents are
    compared by digest; NULL is a key like any other.  A key's versions are cut into blocks of about
    ``block_size`` by their place between its least and greatest ``seq``, so a
    hot key is spread over window partitions.
    """
    keys = list(keys)
    if batch_keys is None:
        batch_keys = broadcast_if_small(batch.select(*keys).distinct(), BATCH_KEYS_BROADCAST_ROWS)
    affected = join_same(stored, batch_keys, keys, "left_semi")
    v = _versions(affected, batch, keys, seq)
    span = batch.groupBy(*keys).agg(F.min(seq).alias("_low"), F.max(seq).alias("_high"), F.ceil(F.count(F.lit(1)) / F.lit(block_size)).alias("_blocks"))
    span = span.filter("_blocks > 1")  # few keys: those with more than one block
    place = (F.col("_seq") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1).cast("double")
    v = join_same(v, span, keys, "left").withColumn(
        "_blk", F.when(F.col("_stored"), F.lit(-1)).otherwise(F.coalesce(F.floor(place * F.col("_blocks")), F.lit(0))).cast("long")
    ).drop("_low", "_high", "_blocks")
    w = Window.partitionBy(*keys, "_blk").orderBy("_ord")
    v = v.withColumn("_rn", F.row_number().over(w)).withColumn("_prev", F.lag("_digest").over(w))
    # equal numbers of a key are in one block, next to each other
    v = v.withColumn("_tied", ~F.col("_stored") & (F.col("_seq").isNull() | F.coalesce(F.lag("_seq").over(w) == F.col("_seq"), F.lit(False))))
    # last digest of every (key, block); the previous existing block is found by a window over blocks
    last = v.groupBy(*keys, "_blk").agg(F.max_by("_digest", "_ord").alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_blk")
    last = last.select(*keys, "_blk", F.lag("_last").over(wb).alias("_carry"), F.lag("_blk").over(wb).alias("_pblk"))
    v = join_same(v, last, [*keys, "_blk"], "left")
    has_prev = (F.col("_rn") > 1) | F.col("_pblk").isNotNull()
    prev = F.when(F.col("_rn") > 1, F.col("_prev")).otherwise(F.col("_carry"))
    same = F.col("_digest").eqNullSafe(prev)
    action = (
        F.when(F.col("_stored"), F.lit(None).cast("string"))
        .when(~has_prev, F.lit("inserted"))
        .when(~same, F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    applied = F.col("_stored") | ~has_prev | ~same
    return v.withColumn("_applied", applied).withColumn("action", action).drop("_rn", "_prev", "_carry", "_pblk", "_digest")


def reject_ties(marked: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """``marked`` as it is; raises if a batch row has no number or shares it within its key."""
    tied = marked.where("_tied").select(*keys, F.col("_seq").alias(seq)).limit(1).collect()
    if tied:
        raise ValueError(f"{seq} is missing or not unique within its key: {tied[0].asDict()}")
    return marked


def upsert(
    stored: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    seq: str = "seq",
    block_size: int = 100_000,
    refresh_on_change: bool = False,
    derived: Sequence[str] = ("summaries",),
    check_unique: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """JN2 + WN1: new snapshot and per-version actions.

    Returns ``(snapshot, actions)``; the snapshot has the stored schema.  Keys
    not in the batch pass through untouched.  Write the snapshot to a new
    location (or MERGE where the table format supports it).  The marked
    versions (keys, numbers and actions, no texts) are checkpointed once for
    both results; whole rows are joined for the winning versions only.  A batch
    row without ``seq``, or two with the same one in a key, are an error: their
    order, and so the result, would not be defined.

    S6: like the reference, stored-only fields survive a content change, so
    derived data (summaries, and vectors keyed on them) goes stale.  With
    ``refresh_on_change=True`` the ``derived`` columns are cleared when the
    final content came from the batch, so the next summarise / vector-load
    run regenerates them.
    """
    keys = list(keys)
    if check_unique:
        # TK6: the stored table must hold one row per key for "find one" semantics
        assert_unique(stored, keys)
    marked = reject_ties(cut_lineage(mark_versions(stored, batch, keys, seq, block_size)), keys, seq)
    fields = [c for c in batch.columns if c != seq and c not in keys]
    stored_only = [c for c in stored.columns if c not in fields and c not in keys]
    # the last applied version of each key; NULL number: the stored row stays as it is
    final = marked.filter("_applied").groupBy(*keys).agg(F.max_by("_seq", "_ord").alias(seq)).filter(F.col(seq).isNotNull())
    kept = join_same(stored, final.select(*keys), keys, "left_anti")
    changed = join_same(batch.withColumn(seq, F.col(seq).cast("long")), final, [*keys, seq])
    old = stored.select(*keys, *[F.lit(None).cast(stored.schema[c].dataType).alias(c) if refresh_on_change and c in derived else F.col(c) for c in stored_only])
    snapshot = kept.unionByName(join_same(changed, old, keys, "left").select(*stored.columns))
    actions = marked.filter(F.col("action").isNotNull()).select(*keys, F.col("_seq").alias(seq), "action")
    return snapshot, actions


def action_counts(actions: DataFrame) -> DataFrame:
    """AG9: run counters per action."""
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
