"""Adjacency of geometries that share arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(arc_refs: DataFrame, mode: str = "first") -> DataFrame:
    """(geom_id, nbr), distinct, without self, of the references of one layer.

    "first": of each arc only the first geometry that has it forward and the first that has
    it reversed can be neighbours of others. Whoever has the arc, in either direction, sees
    the forward one, and the forward one sees the reversed one; so where more than two
    share an arc, or two in one direction, it isn't symmetric. "all": every geometry of an
    arc and the arc's first one see each other, so two users always do, and what more users
    give grows with their number, not with its square.
    """
    if mode == "first":
        sides = arc_refs.groupBy("arc_id").agg(F.min(F.when(F.col("forward"), F.col("geom_id"))).alias("fwd"), F.min(F.when(~F.col("forward"), F.col("geom_id"))).alias("rev"))
        seen = arc_refs.select("geom_id", "arc_id").distinct().join(sides, "arc_id")
        out = seen.select("geom_id", F.when(F.col("fwd") == F.col("geom_id"), F.col("rev")).otherwise(F.col("fwd")).alias("nbr"))
    elif mode == "all":
        own = arc_refs.select("arc_id", "geom_id").distinct()
        star = own.join(own.groupBy("arc_id").agg(F.min("geom_id").alias("nbr")), "arc_id")
        out = star.select(F.explode(F.array(F.struct("geom_id", "nbr"), F.struct(F.col("nbr").alias("geom_id"), F.col("geom_id").alias("nbr")))).alias("e")).select("e.*")
    else:
        raise ValueError(mode)
    return out.where("nbr IS NOT NULL AND geom_id <> nbr").distinct()


def neighbors(arc_refs: DataFrame, features: DataFrame, mode: str = "first") -> DataFrame:
    """(geom_id, neighbors sorted) for each feature, empty ones included."""
    lists = edges(arc_refs, mode).groupBy("geom_id").agg(F.sort_array(F.collect_list("nbr")).alias("neighbors"))
    return features.select("geom_id").join(lists, "geom_id", "left").select("geom_id", F.coalesce("neighbors", F.array().cast("array<int>")).alias("neighbors"))
