"""Connected components on DataFrames, by alternating large and small stars, in stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, hot_from, join_counted, stored

#: Rows of a round for each of its files, and files that a round can have however few its rows.
FILE_ROWS, FILES = 200_000, 8


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the smallest node reachable; any orderable type.

    Each round hangs every node's larger neighbours, then its smaller ones, under the
    smallest; rounds grow with the logarithm of the longest path. Rounds are written to the
    shared folder, and hubs (nodes of very many edges) meet their edges by a broadcast of
    the hubs, not in one task. Self-loops, nulls and repeats are dropped; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, rows = None, now.count()
    while True:
        hot = hot_from(2 * rows)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("a", "m"))
        large = join_counted(both, low, ["a"], "_n", hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = join_counted(large, low, ["a"], "_n", hot).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        # a round has at most twice the rows of the last one, and few rows don't need a file of each shuffle partition
        before, now = now, stored(small.coalesce(max(FILES, -(-2 * rows // FILE_ROWS))))
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, rows = new, new[0]
