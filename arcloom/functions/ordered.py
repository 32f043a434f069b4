"""Global ordered computations that don't meet in one task: prefix sums and ranks by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def prefix_sum(df: DataFrame, key: str, value: Column, name: str, block: int = 65_536) -> DataFrame:
    """Adds the exclusive sum of value by key (integers, any gaps): in blocks of keys, then over their totals."""
    df = df.withColumn("_b", F.floor(F.col(key) / block)).withColumn("_v", value.cast("long"))
    totals = df.groupBy("_b").agg(F.sum("_v").alias("_t"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_own", own).join(totals, "_b").withColumn(name, F.col("_own") + F.col("_before")).drop("_b", "_v", "_own", "_before")


def lag_by_block(df: DataFrame, key: str, value: str, name: str, block: int = 65_536) -> DataFrame:
    """Adds the value at key - 1 (0 at the start of dense keys), by a join instead of a global window."""
    before = df.select((F.col(key) + 1).alias(key), F.col(value).alias(name))
    return df.join(before, key, "left").fillna({name: 0})


def ranked(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Adds the place (from 0) in the order, which must be total: range partitions (stored), then their counts."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_id", "_p", "_i", "_before")
