"""Selections as a stream: each micro-batch is dissolved as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge


def stream_merges(selections: DataFrame, arc_refs: DataFrame, arcs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes merge() of each micro-batch of selections as Parquet under path, in a folder for each batch."""

    def one(batch: DataFrame, number: int) -> None:
        merge(batch, arc_refs, arcs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return selections.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
