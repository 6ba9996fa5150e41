"""Prefix trie of conversations, rolled up by depth bands.

1. Turns become digests; no text is shuffled.  A turn's place in its
   conversation comes from one range sort of all turns and running counts by
   conversation and range, so a conversation of any length is spread over tasks.
2. Conversations are rebuilt from the first turns of their base and their own.
3. The first d turns of a conversation are named by two 64-bit values: the
   exclusive or of hashes of (digest, place), which adds up over any blocks.
   Running values are built in blocks of ``BAND`` turns, then over the blocks'
   totals, and so on.  Rows with equal names are one node; its smallest member
   and its depth identify it from then on.  Two of a billion prefixes share a
   name with probability 2**-69.
4. Sums over subtrees: depths are cut into bands of ``BAND``.  Every node
   explodes only to its ancestors in its band, which gives each band root the
   sum of its band.  Band roots are a trie again, ``BAND`` times as flat, whose
   totals come the same way; a completed total then goes to the ancestors in the
   band above.  So there are about log(depth) rounds to the base ``BAND``, and a
   row becomes at most ``BAND`` in each.
5. Ids of members that end in a node are sorted by range and joined to strings
   of bounded size, which one pass hashes in order; no list is gathered.

Defined results: rows with a null conversation id take no part; a null role or
text is empty; turns are ordered by number, null first, those of one number by
the SHA-256 digest of role and text; repeated rows are turns of their own; an id's
remainder has its sign, as in SQL; texts are read whole, however long; other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: depths in a band
BAND = 8
#: conversations whose ids can share a base, and most turns taken from it
SIBLINGS, SHARED = 5, 9
#: characters of ids joined before they are hashed
CHUNK = 1 << 16


def ranked_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, place, digest, bytes)``: turns by their place (from 1) in each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    ranged = cut_lineage(rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest", "row").withColumn("part", F.spark_partition_id()))
    local = ranged.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")))
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n"))
    return local.join(before.select("conv_id", "part", "before"), ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("place"), "digest", "bytes")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, digest, bytes)`` of rebuilt conversations; ``convs`` has ``base``, ``h`` and ``given`` of each."""
    own = turns.join(convs.select("conv_id", "h", "given"), "conv_id").where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "digest", "bytes")
    first = turns.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    shared = first.join(convs.where("given > 0").select("conv_id", "base", "given"), "base").where("place <= given")
    return own.unionByName(shared.select("conv_id", F.col("place").alias("depth"), "digest", "bytes"))


def running(rows: DataFrame, longest: int, band: int) -> DataFrame:
    """``rows(conv_id, depth, a, b)`` with ``a`` and ``b`` the exclusive or of all up to each depth (from 1)."""
    block = F.floor((F.col("depth") - 1) / band)
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("block", block).withColumns({c: F.bit_xor(c).over(w) for c in ("a", "b")})
    if longest <= band:
        return inside.drop("block")
    whole = rows.groupBy("conv_id", (block + 1).alias("depth")).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    upper = running(whole, -(-longest // band), band).select("conv_id", F.col("depth").alias("block"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    joined = inside.join(upper, ["conv_id", "block"], "left")  # the blocks before: those up to the one before this
    both = lambda c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"u{c}"), F.lit(0).cast("long"))).alias(c)
    return joined.select(*[both(c) if c in "ab" else F.col(c) for c in rows.columns])


def paths(members: DataFrame, step: int, band: int) -> DataFrame:
    """``(conv_id, depth, node, path)``: nodes of a member's prefixes at depths that ``step`` divides, in each band down to its own."""
    w = Window.partitionBy("conv_id", F.floor(F.col("depth") / (step * band))).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return members.where(F.col("depth") % step == 0).select("conv_id", "depth", "node", F.collect_list("node").over(w).alias("path"))


def _summed(rows: DataFrame, top: Column, step: int, columns: list[str]) -> DataFrame:
    """Sums by ancestor; ``path`` lists them from depth ``top``, ``step`` apart."""
    spread = rows.select(F.posexplode("path").alias("k", "conv_id"), top.alias("top"), *columns)
    return spread.groupBy("conv_id", (F.col("top") + F.col("k") * step).alias("depth")).agg(*[F.sum(c).alias(c) for c in columns])


def rolled_up(values: DataFrame, members: DataFrame, deepest: int, columns: list[str], band: int = BAND, step: int = 1) -> DataFrame:
    """``(conv_id, depth, *columns)``: each node's sums over its subtree.

    ``values`` has a row per node at the depths that ``step`` divides.
    """
    lined = cut_lineage(paths(members, step, band))
    own = lined.where("conv_id = node").select("conv_id", "depth", "path")
    wide = step * band
    inside = _summed(values.join(own, ["conv_id", "depth"]), F.col("depth") - F.col("depth") % wide, step, columns)
    if deepest < wide:
        return inside
    inside = cut_lineage(inside)
    done = rolled_up(inside.where(F.col("depth") % wide == 0), members, deepest, columns, band, wide)
    # a band root's parent is the last of the band above: the root's first member has passed it
    above = lined.where((F.col("depth") + step) % wide == 0).select("conv_id", (F.col("depth") + step).alias("depth"), "path")
    passed = _summed(done.where("depth > 0").join(above, ["conv_id", "depth"]), F.col("depth") - wide, step, columns)
    return inside.unionByName(passed).groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in columns])


def joined_ids(rows: DataFrame) -> DataFrame:
    """``(node, depth, sha256)``: digest of the comma-joined ids ``conv_id`` of each node, ascending."""
    fields = "node long, depth long, first long, ids string"

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of ids of one node, at most about ``CHUNK`` characters each; a node may have several."""
        for part in parts:
            node, depth, ids = (np.asarray(part.column(c)) for c in range(3))
            head = np.concatenate([np.ones(min(1, len(ids)), bool), (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
            start = np.arange(len(ids)) - np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
            cuts = np.flatnonzero(start % (CHUNK // 20) == 0)
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(node[cuts]), pa.array(depth[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], ["node", "depth", "first", "ids"])

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, hashlib.sha256(), []
        for part in parts:
            for node, depth, text in zip(*(part.column(c).to_pylist() for c in (0, 1, 3))):
                if (node, depth) == now:
                    state.update(f",{text}".encode())
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (node, depth), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "sha256"), r)) for r in out], schema)
            out = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "sha256"), (*now, state.hexdigest())))], schema)

    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("sha256", pa.string())])
    keys = ["node", "depth", "conv_id"]
    texts = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(join, fields)
    return texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digest, "node long, depth long, sha256 string")


def prefix_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", band: int = BAND
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    ranked = cut_lineage(ranked_turns(turns, id_col, turn_col, role_col, text_col))
    sizes = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % SIBLINGS).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = cut_lineage(convs.withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))))
    length = (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("length")
    rows = cut_lineage(rebuilt(ranked, convs))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    hashed = rows.select("conv_id", "depth", F.xxhash64(F.lit(1), "digest", "depth").alias("a"), F.xxhash64(F.lit(2), "digest", "depth").alias("b"), "bytes")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes")])
    named = cut_lineage(running(hashed, deepest, band).unionByName(roots))
    nodes = named.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    nodes = cut_lineage(nodes)
    members = cut_lineage(named.select("conv_id", "depth", "a", "b").join(nodes.select("depth", "a", "b", "node"), ["depth", "a", "b"]).select("conv_id", "depth", "node"))
    # a node's parent: the node one less deep on the way of its smallest member
    upper = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    placed = nodes.select(F.col("node").alias("conv_id"), "depth", "n_convs", "bytes").join(upper, ["conv_id", "depth"], "left")
    children = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    placed = cut_lineage(placed.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    values = placed.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = rolled_up(values, members, deepest, ["n_leaves", "saved_tokens"], band)
    ends = joined_ids(members.join(convs.select("conv_id", length.alias("depth")), ["conv_id", "depth"]))
    ends = ends.select(F.col("node").alias("conv_id"), "depth", "sha256")
    nobody = F.lit(hashlib.sha256().hexdigest())
    return placed.join(totals, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", nobody).alias("ends_sha256")
    )
