"""Dissolving selections of features: membership, boundary, components, rings.

All merges run as one job keyed by merge_id. Counting, the choice of boundary arcs, their
endpoints and all coordinates stay in the JVM. Chaining boundary references into rings
depends on their order, which a walk over polygons that share arcs defines; that is a
grouped function. It gets a row for each polygon: the ids of its shared arcs (for the walk)
and its boundary references with endpoints. With walk=False polygons go by their place
in the selection instead, components come from a distributed job, and only polygons with
boundary references are sent at all.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .components import components

POLY = ["input_ord", "ord", "poly_idx"]


def checked(selection: DataFrame, features: DataFrame) -> DataFrame:
    """selection; raises where a (layer, geom_id) is unknown."""
    unknown = selection.join(features.select("layer", "geom_id"), ["layer", "geom_id"], "left_anti")
    if row := unknown.first():
        raise ValueError(f"unknown geometry {row['layer']!r}, {row['geom_id']}")
    return selection


def expand(selection: DataFrame, arc_refs: DataFrame) -> DataFrame:
    """One row for each reference of each selected polygon; a geometry selected twice counts twice."""
    return selection.join(arc_refs, ["layer", "geom_id"])


def membership(refs: DataFrame) -> DataFrame:
    """(merge_id, arc_id, n): how often each arc occurs over the selected polygons."""
    return refs.groupBy("merge_id", "arc_id").agg(F.count("*").alias("n"))


def boundary(refs: DataFrame) -> DataFrame:
    """refs of arcs that occur exactly once; three occurrences cancel as two do."""
    once = membership(refs).where("n = 1").select("merge_id", "arc_id")
    return refs.join(once, ["merge_id", "arc_id"])


def polygon_components(refs: DataFrame) -> DataFrame:
    """(merge_id, input_ord, ord, poly_idx, root): polygons that share an arc have one root, the first of them.

    Polygons of an arc hang together as a star around its first, so the edges are as many
    as the references.
    """
    node = F.struct("merge_id", *POLY)
    polygons = refs.select("merge_id", *POLY, "arc_id", node.alias("node"))
    first = polygons.groupBy("merge_id", "arc_id").agg(F.min("node").alias("b"))
    edges = polygons.join(first, ["merge_id", "arc_id"]).select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    roots = components(edges)
    return polygons.select("node").distinct().join(roots, "node", "left").select("node.*", F.coalesce("root", "node").alias("root"))


# the grouped step


def discover(polygons: list[list[int]]) -> list[list[int]]:
    """Groups of polygons (by ordinal) that share arcs, in the order in which a depth-first walk finds them."""
    users: dict[int, list[int]] = {}
    for p, arcs in enumerate(polygons):
        for a in arcs:
            users.setdefault(a, []).append(p)
    seen, groups = [False] * len(polygons), []
    for seed in range(len(polygons)):
        if seen[seed]:
            continue
        seen[seed], group, stack = True, [seed], [seed]
        while stack:
            for a in polygons[stack.pop()]:
                for q in users[a]:
                    if not seen[q]:
                        seen[q] = True
                        group.append(q)
                        stack.append(q)
        groups.append(group)
    return groups


def stitch(refs: list[int], starts: list, ends: list) -> list[list[int]]:
    """Chains directed references into rings: at a free end first, else at a free start.

    What stays open is given too; dicts keep the order of insertion, on which rings' order
    depends where more than two arcs meet.
    """
    by_end: dict = {}
    by_start: dict = {}
    for ref, a, b in zip(refs, starts, ends, strict=True):
        piece = by_end.pop(a, None)
        if piece is not None:  # goes on at its end
            piece[0].append(ref)
            piece[2] = b
            other = by_start.get(b)
            if other is None:
                by_end[b] = piece
                continue
            del by_start[b]
            if other is not piece:
                by_end.pop(other[2], None)
                by_start.pop(piece[1], None)
                piece[0].extend(other[0])
                piece[2] = other[2]
            by_start[piece[1]] = by_end[piece[2]] = piece
            continue
        piece = by_start.pop(b, None)
        if piece is not None:  # begins before its start
            piece[0].appendleft(ref)
            piece[1] = a
            by_start[a] = piece
            continue
        piece = [deque([ref]), a, b]
        by_start[a] = by_end[b] = piece
    rings, given = [], set()
    for piece in [*by_end.values(), *by_start.values()]:
        if id(piece) not in given:
            given.add(id(piece))
            rings.append(list(piece[0]))
    used = {r for ring in rings for r in ring}
    return rings + [[r] for r in refs if r not in used]


RINGS = "merge_id long, poly_idx int, ring_idx int, pos int, arc_ref int"


EDGE = ["arc_ref", "sx", "sy", "ex", "ey"]


def polygon_rows(refs: DataFrame, arcs: DataFrame, keys: list[str], walk: bool) -> DataFrame:
    """A row for each polygon: keys, the arcs that it shares with others, and its boundary references, each in their order.

    Arcs that cancel are counted out before any endpoint is looked up.
    """
    times = F.count("*").over(Window.partitionBy("merge_id", "arc_id"))
    counted = refs.select(*keys, "ring_idx", "pos", "arc_id", "arc_ref", times.alias("n"))
    single = counted.where("n = 1").join(arcs.select("arc_id", "sx", "sy", "ex", "ey"), "arc_id")
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct("ring_idx", "pos", *c)))
    edge = single.groupBy(*keys).agg(in_order(*EDGE).alias("e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in EDGE])
    if not walk:
        return edge.withColumn("shared", F.array().cast("array<int>"))
    shared = counted.where("n > 1").groupBy(*keys).agg(in_order("arc_id").alias("s")).select(*keys, F.col("s.arc_id").alias("shared"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    return edge.join(shared, keys, "full").select(*keys, empty("arc_ref", "int"), *[empty(c, "double") for c in EDGE[1:]], empty("shared", "int"))


def stitch_merge(rows: pd.DataFrame, walk: bool = True) -> pd.DataFrame:
    """All polygons of one merge (or of one component of it) to its rings' references."""
    rows = rows.sort_values(POLY, kind="stable")
    groups = discover([x.tolist() for x in rows["shared"]]) if walk else [list(range(len(rows)))]
    refs, starts, ends = [], [], []
    for ref, sx, sy, ex, ey in zip(*(rows[c] for c in EDGE), strict=True):
        a, b = list(zip(sx.tolist(), sy.tolist(), strict=True)), list(zip(ex.tolist(), ey.tolist(), strict=True))
        back = np.asarray(ref) < 0
        refs.append(ref.tolist())
        starts.append([q if r else p for p, q, r in zip(a, b, back, strict=True)])
        ends.append([p if r else q for p, q, r in zip(a, b, back, strict=True)])
    out, poly = [], 0
    for group in groups:
        flat = lambda x: [v for p in group for v in x[p]]  # noqa: B023, E731
        rings = stitch(flat(refs), flat(starts), flat(ends))
        out += [(poly, n, pos, r) for n, ring in enumerate(rings) for pos, r in enumerate(ring)]
        poly += bool(rings)
    found = pd.DataFrame(out, columns=["poly_idx", "ring_idx", "pos", "arc_ref"])
    found.insert(0, "merge_id", rows["merge_id"].iloc[0])
    return found


def merge_arcs(selection: DataFrame, arc_refs: DataFrame, arcs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(merge_id, poly_idx, ring_idx, pos, arc_ref): rings as references; needs endpoints only.

    Given features, a selected geometry that is none of them raises; without, it is passed over.
    """
    selection = selection if features is None else checked(selection, features)
    rows = polygon_rows(expand(selection, arc_refs), arcs, ["merge_id", *POLY], True)
    return rows.groupBy("merge_id").applyInPandas(lambda rows: stitch_merge(rows), RINGS)


def merge_arcs_by_component(selection: DataFrame, arc_refs: DataFrame, arcs: DataFrame, walk: bool = True) -> DataFrame:
    """merge_arcs for merges too large for a task: components come from a distributed job, a task holds one of them.

    With walk=False only boundary references leave the JVM; rings are then the same but
    where more than two of them meet in a point.
    """
    refs = expand(selection, arc_refs)
    roots = polygon_components(refs)
    rows = polygon_rows(refs.join(roots, ["merge_id", *POLY]), arcs, ["root", "merge_id", *POLY], walk)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        seed = key[0]
        out = stitch_merge(part, walk)
        return out.assign(**{f"seed_{c}": seed[c] for c in POLY})

    found = rows.groupBy("root").applyInPandas(one, RINGS + ", seed_input_ord int, seed_ord int, seed_poly_idx int")
    place = F.dense_rank().over(Window.partitionBy("merge_id").orderBy(*[f"seed_{c}" for c in POLY])) - 1
    return found.withColumn("poly_idx", place.cast("int")).drop(*[f"seed_{c}" for c in POLY])


def ring_coords(rings: DataFrame, arcs: DataFrame) -> DataFrame:
    """(merge_id, poly_idx, ring_idx, arcs, coords, area2); coordinates never leave the JVM."""
    part = rings.withColumn("arc_id", S.arc_id(F.col("arc_ref"))).join(arcs.select("arc_id", "points"), "arc_id")
    part = part.select("merge_id", "poly_idx", "ring_idx", "pos", "arc_ref", S.without_last(S.directed(F.col("points"), F.col("arc_ref"))).alias("points"))
    whole = part.groupBy("merge_id", "poly_idx", "ring_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "arc_ref", "points"))).alias("parts"))
    coords = whole.select("merge_id", "poly_idx", "ring_idx", F.col("parts.arc_ref").alias("arcs"), S.close(F.flatten(F.col("parts.points"))).alias("coords"))
    return coords.withColumn("area2", S.area2(F.col("coords")))


def merge(selection: DataFrame, arc_refs: DataFrame, arcs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(merge_id, poly_idx, ring_idx, is_exterior, arcs, coords, area2).

    Rings of fewer than 4 points go; of each polygon the ring of the largest area comes
    first. A selection without boundary gives no rows. Given features, unknown geometries raise.
    """
    rings = ring_coords(merge_arcs(selection, arc_refs, arcs, features), arcs).where(F.size("coords") >= 4)
    ring = F.row_number().over(Window.partitionBy("merge_id", "poly_idx").orderBy(F.desc("area2"), "ring_idx")) - 1
    poly = F.dense_rank().over(Window.partitionBy("merge_id").orderBy("poly_idx")) - 1
    return rings.withColumn("ring_idx", ring).withColumn("poly_idx", poly).select("merge_id", "poly_idx", "ring_idx", (F.col("ring_idx") == 0).alias("is_exterior"), "arcs", "coords", "area2")


def bbox(arcs: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1) of all points: one row, nulls without any."""
    p = arcs.select(F.explode("points").alias("p"))
    return p.agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))


def geojson(merged: DataFrame, canonical: bool = False) -> DataFrame:
    """(merge_id, geometry): a MultiPolygon as JSON text for each merge.

    canonical: each ring starts at its least point, so that equal shapes give equal texts.
    """
    coords = S.least_first(F.col("coords")) if canonical else F.col("coords")
    ring = F.transform(coords, lambda p: F.array(p["x"], p["y"]))
    polygons = merged.groupBy("merge_id", "poly_idx").agg(F.array_sort(F.collect_list(F.struct("ring_idx", ring.alias("ring")))).alias("rings"))
    whole = polygons.groupBy("merge_id").agg(F.array_sort(F.collect_list(F.struct("poly_idx", F.col("rings.ring").alias("polygon")))).alias("polygons"))
    return whole.select("merge_id", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons.polygon").alias("coordinates"))).alias("geometry"))
