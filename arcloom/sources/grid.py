"""A topology derived from `customer`: a grid of unit cells, 25 wide, with dense keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 25


@dataclass(frozen=True)
class Topology:
    """arcs(arc_id, points, sx, sy, ex, ey); arc_refs(layer, geom_id, poly_idx, ring_idx, pos, arc_ref, arc_id, forward); features; selection by nation."""

    arcs: DataFrame
    arc_refs: DataFrame
    features: DataFrame
    selection: DataFrame
    height: int


def refs_of(cells: DataFrame, height: int, layer: str, geom, poly) -> DataFrame:
    """Four references of each unit cell (x, y), counter-clockwise."""
    x, y, up = F.col("x"), F.col("y"), (height + 1) * WIDTH
    ring = [y * WIDTH + x, up + y * (WIDTH + 1) + x + 1, F.bitwise_not((y + 1) * WIDTH + x), F.bitwise_not(up + y * (WIDTH + 1) + x)]
    rows = cells.select(F.lit(layer).alias("layer"), geom.cast("int").alias("geom_id"), poly.cast("int").alias("poly_idx"), F.lit(0).alias("ring_idx"), F.posexplode(F.array(*[r.cast("int") for r in ring])).alias("pos", "arc_ref"))
    return rows.withColumn("arc_id", F.when(F.col("arc_ref") < 0, F.bitwise_not("arc_ref")).otherwise(F.col("arc_ref"))).withColumn("forward", F.col("arc_ref") >= 0)


def grid(spark: SparkSession, sf_dir: str) -> Topology:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    height = customer.count() // WIDTH
    cells = customer.withColumn("x", (F.col("c_custkey") % WIDTH).cast("int")).withColumn("y", F.floor(F.col("c_custkey") / WIDTH).cast("int"))
    across = (height + 1) * WIDTH
    k = F.col("id")
    x = F.when(k < across, k % WIDTH).otherwise((k - across) % (WIDTH + 1)).cast("double")
    y = F.when(k < across, F.floor(k / WIDTH)).otherwise(F.floor((k - across) / (WIDTH + 1))).cast("double")
    ends = spark.range(across + height * (WIDTH + 1)).select(k.cast("int").alias("arc_id"), x.alias("sx"), y.alias("sy"), F.when(k < across, x + 1).otherwise(x).alias("ex"), F.when(k < across, y).otherwise(y + 1).alias("ey"))
    arcs = ends.select("arc_id", F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"))).alias("points"), "sx", "sy", "ex", "ey")
    features = cells.select(F.lit("cell").alias("layer"), F.col("c_custkey").cast("int").alias("geom_id"), F.lit("Polygon").alias("geom_type"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey", "x", "y")
    selection = features.select(F.col("c_nationkey").cast("long").alias("merge_id"), F.lit(0).alias("input_ord"), F.col("geom_id").alias("ord"), "layer", "geom_id")
    return Topology(arcs, refs_of(cells, height, "cell", F.col("c_custkey"), F.lit(0)), features, selection, height)


def tile_selection(topology: Topology) -> DataFrame:
    """Merges of 5 by 5 cells."""
    tile = F.floor(F.col("y") / 5) * 5 + F.floor(F.col("x") / 5)
    return topology.features.select(tile.cast("long").alias("merge_id"), F.lit(0).alias("input_ord"), F.col("geom_id").alias("ord"), "layer", "geom_id")
