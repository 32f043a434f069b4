"""Packing arcs into blocks, looking blocks up, deltas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lag_by_block, prefix_sum
from ..functions.scalar import MOD

TARGET = 4096


def pack(sizes: list[int], target: int = TARGET) -> list[int]:
    """Block numbers: sizes in order, a block ends before it would pass the target; an oversize one is alone."""
    out, block, used = [], 0, 0
    for n in sizes:
        if used and used + n > target:
            block, used = block + 1, 0
        out.append(block)
        used += n
    return out


def packed(batches: Iterator[pa.RecordBatch], size: str, target: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches (arc_id, size) with block_id; only the open block's fill is kept from batch to batch."""
    block, used = 0, 0
    for batch in batches:
        sizes, out = np.asarray(batch.column(size), np.int64), []
        for n in sizes.tolist():
            if used and used + n > target:
                block, used = block + 1, 0
            out.append(block)
            used += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "block_id"])


def assign_blocks(arcs: DataFrame, size: str = "byte_len", target: int = TARGET) -> DataFrame:
    """(arc_id, byte_len, block_id).

    Packing resets where a block ends, so where a block starts depends on all blocks before
    it. It is one ordered scan over two integers an arc, in batches, so nothing grows with the table
    but its time; no arrays, points or bytes go through it.
    """
    rows = arcs.select("arc_id", F.col(size).cast("long").alias(size))
    dealt = rows.repartition(1).sortWithinPartitions("arc_id")
    return dealt.mapInArrow(lambda b: packed(b, size, target), f"arc_id int, {size} long, block_id long")


def block_offsets(blocks: DataFrame, size: str = "byte_len") -> DataFrame:
    """Adds each arc's offset in its block."""
    w = Window.partitionBy("block_id").orderBy("arc_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("local_offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def lookup(blocks: DataFrame, ids: DataFrame, span: int = 65_536) -> DataFrame:
    """(arc_id, block_id) by the largest first arc id not above each id: an as-of join on sorted starts.

    Starts and ids are dealt by ranges of `span` ids; each range also gets the block open at its start.
    """
    firsts = blocks.groupBy("block_id").agg(F.min("arc_id").alias("at"), F.max("arc_id").alias("to"))
    starts = firsts.select(F.explode(F.sequence(F.floor(F.col("at") / span), F.floor(F.col("to") / span))).alias("range"), "at", "block_id")
    asked = ids.select(F.floor(F.col("arc_id") / span).alias("range"), F.col("arc_id").alias("at"), F.lit(None).cast("long").alias("block_id"), F.lit(True).alias("asked"))
    w = Window.partitionBy("range").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.withColumn("asked", F.lit(False)).unionByName(asked).withColumn("open", F.last("block_id", ignorenulls=True).over(w))
    return found.where("asked").select(F.col("at").alias("arc_id"), F.col("open").alias("block_id"))


def delta_encode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `delta` mod 2**32 along dense keys."""
    return lag_by_block(df, key, value, "_before").withColumn("delta", F.pmod(F.col(value) - F.col("_before"), F.lit(MOD))).drop("_before")


def delta_decode(df: DataFrame, key: str) -> DataFrame:
    """Adds `value`: the running sum of delta mod 2**32."""
    return prefix_sum(df, key, F.col("delta"), "_sum").withColumn("value", F.pmod(F.col("_sum") + F.col("delta"), F.lit(MOD))).drop("_sum")
