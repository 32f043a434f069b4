"""Orders of arcs for locality: Hilbert, strips, greedy paths; outlines first."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.ordered import ranked


def ref_counts(arc_refs: DataFrame, arcs: DataFrame) -> DataFrame:
    """(arc_id, ref_fwd, ref_rev, ref_count, outline) over all layers; unused arcs have 0."""
    n = arc_refs.groupBy("arc_id").agg(F.sum(F.when(F.col("forward"), 1).otherwise(0)).alias("ref_fwd"), F.sum(F.when(F.col("forward"), 0).otherwise(1)).alias("ref_rev"))
    n = arcs.select("arc_id").join(n, "arc_id", "left").fillna(0, ["ref_fwd", "ref_rev"])
    return n.select("arc_id", "ref_fwd", "ref_rev", (F.col("ref_fwd") + F.col("ref_rev")).alias("ref_count"), (F.col("ref_fwd") != F.col("ref_rev")).alias("outline"))


def keyed(arcs: DataFrame, arc_refs: DataFrame) -> DataFrame:
    """ref_counts with each arc's first point and Hilbert key in the box of all first points."""
    box = arcs.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"))
    b = box.first()
    lit = lambda k: F.lit(float(b[k] or 0.0))
    key = S.hilbert_key(S.grid_cell(F.col("sx"), lit("x0"), lit("x1")), S.grid_cell(F.col("sy"), lit("y0"), lit("y1")))
    return arcs.select("arc_id", "sx", "sy", key.alias("key")).join(ref_counts(arc_refs, arcs), "arc_id")


def outline_first(df: DataFrame, order: list) -> DataFrame:
    """(arc_id, new_id): outline arcs in order, then the rest."""
    return ranked(df, [F.desc("outline"), *order], "new_id").select("arc_id", "new_id")


def hierarchical_hilbert(arcs: DataFrame, arc_refs: DataFrame) -> DataFrame:
    return outline_first(keyed(arcs, arc_refs), [F.desc("ref_count"), F.asc("key"), F.asc("arc_id")])


def hierarchical_str(arcs: DataFrame, arc_refs: DataFrame) -> DataFrame:
    """Tiers of equal reference counts, the highest first; in each, strips by x, each by y."""
    df = keyed(arcs, arc_refs)
    sizes = df.groupBy("ref_count").agg(F.count("*").alias("n"))
    per = F.ceil(F.col("n") / F.ceil(F.sqrt("n")))
    df = df.join(F.broadcast(sizes), "ref_count").withColumn("per", per)
    place = F.row_number().over(Window.partitionBy("ref_count").orderBy("sx", "arc_id")) - 1
    df = df.withColumn("strip", F.floor(place / F.col("per")))
    return outline_first(df, [F.desc("ref_count"), F.asc("strip"), F.asc("sy"), F.asc("sx"), F.asc("arc_id")])


def first_visits(arc_refs: DataFrame, arcs: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """hilbert: geometries walk along the curve by their first point; an arc's place is its first visit.

    Geometries at one place go by their layer's place in `layers` (by name where not given,
    or not listed), then by id. One layer or none: arcs keep their order. Arcs without a
    visit come first in their group.
    """
    names = [r.layer for r in arc_refs.select("layer").distinct().orderBy("layer").collect()]
    if len(names) <= 1:
        return arcs.select("arc_id", F.col("arc_id").cast("long").alias("new_id"))
    listed = [*(layers or []), *(x for x in names if x not in (layers or []))]
    place = F.array_position(F.array(*map(F.lit, listed)), F.col("layer"))
    counts = keyed(arcs, arc_refs).select("arc_id", "outline")
    first = arc_refs.where("poly_idx = 0 AND ring_idx = 0 AND pos = 0").join(arcs.select("arc_id", "sx", "sy"), "arc_id")
    b = first.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    box = [F.lit(float(v or 0.0)) for v in b]
    key = S.hilbert_key(S.grid_cell(F.col("sx"), box[0], box[1]), S.grid_cell(F.col("sy"), box[2], box[3]))
    walk = ranked(first.select("layer", "geom_id", key.alias("key"), place.alias("place")), [F.asc("key"), F.asc("place"), F.asc("geom_id")], "walk")
    visit = arc_refs.join(walk.select("layer", "geom_id", "walk"), ["layer", "geom_id"]).groupBy("arc_id").agg(F.min(F.struct("walk", "poly_idx", "ring_idx", "pos")).alias("visit"))
    return outline_first(counts.join(visit, "arc_id", "left"), [F.asc_nulls_first("visit"), F.asc("arc_id")])


ORDERS = {"hilbert": first_visits, "hierarchical-hilbert": lambda refs, arcs, layers: hierarchical_hilbert(arcs, refs), "hierarchical-str": lambda refs, arcs, layers: hierarchical_str(arcs, refs), "hierarchical-greedy-path": lambda refs, arcs, layers: hierarchical_greedy(arcs, refs)}


def arc_order(arc_refs: DataFrame, arcs: DataFrame, by: str = "hierarchical-hilbert", layers: list[str] | None = None) -> DataFrame:
    """(arc_id, new_id) by the order's name; an unknown one raises."""
    if by not in ORDERS:
        raise ValueError(f"no order {by!r}; there are {', '.join(ORDERS)}")
    return ORDERS[by](arc_refs, arcs, layers)


def inverted(permutation: DataFrame) -> DataFrame:
    """(arc_id, new_id) of the inverse permutation."""
    return permutation.select(F.col("new_id").cast("int").alias("arc_id"), F.col("arc_id").cast("long").alias("new_id"))


#: Places in a leaf of the tree that a greedy path searches.
LEAF = 8


def place_tree(x: np.ndarray, y: np.ndarray) -> tuple[list, list, list]:
    """A balanced tree over distinct places, in the order of a heap: node k has children 2k + 1 and 2k + 2.

    Gives each node's box (low x, high x, low y, high y) of its places; the room around it
    (what lies outside the node has x or y at or beyond one of its four bounds), and the
    leaves' places. A node is halved across its longer side; the last level are the leaves.
    """
    n, depth, inf = len(x), 0, math.inf
    while n >> depth > LEAF:
        depth += 1
    at, starts = np.arange(n), np.array([0, n])
    room, boxes, rooms = np.array([[-inf, inf, -inf, inf]]), [], []
    for level in range(depth + 1):
        first = starts[:-1]
        box = np.column_stack([f.reduceat(v[at], first) for v in (x, y) for f in (np.minimum, np.maximum)])
        boxes += box.tolist()
        rooms += room.tolist()
        if level == depth:
            break
        node = np.repeat(np.arange(len(first)), np.diff(starts))
        tall = box[:, 3] - box[:, 2] > box[:, 1] - box[:, 0]
        side = np.where(tall[node], y[at], x[at])
        order = np.lexsort((side, node))
        at, side = at[order], side[order]
        middle = (starts[:-1] + starts[1:]) // 2
        room = np.repeat(room, 2, axis=0)
        k, axis = 2 * np.arange(len(first)), np.where(tall, 2, 0)
        room[k, axis + 1] = side[middle]  # the right half begins there
        room[k + 1, axis] = side[middle - 1]
        starts = np.sort(np.concatenate([starts, middle]))
    listed = at.tolist()
    return boxes, rooms, [listed[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def nearest_path(x: np.ndarray, y: np.ndarray) -> list[int]:
    """The greedy path over distinct places, always to the nearest left and of equally near ones to the lowest."""
    boxes, rooms, leaves = place_tree(x, y)
    inner = len(leaves) - 1
    live = [2] * inner + [len(x) for x in leaves]  # children with places, or places
    leaf_of = [0] * len(x)
    for k, places in enumerate(leaves, inner):
        for p in places:
            leaf_of[p] = k
    at = int(np.argmin(x + y))
    x, y, order = x.tolist(), y.tolist(), [at]
    for _ in range(len(x) - 1):
        node = leaf_of[at]
        leaves[node - inner].remove(at)
        k = node
        live[k] -= 1
        while not live[k] and k:
            k = (k - 1) >> 1
            live[k] -= 1
        px, py, best, found = x[at], y[at], math.inf, -1
        for p in leaves[node - inner]:
            dx, dy = x[p] - px, y[p] - py
            d = dx * dx + dy * dy
            if d < best or (d == best and p < found):
                best, found = d, p
        while node:
            if found >= 0:
                a, b, c, e = rooms[node]
                gap = min(px - a, b - px, py - c, e - py)
                if gap > 0 and best < gap * gap:
                    break
            todo = [node + 1 if node & 1 else node - 1]
            while todo:
                k = todo.pop()
                if not live[k]:
                    continue
                a, b, c, e = boxes[k]
                dx = a - px if px < a else px - b if px > b else 0.0
                dy = c - py if py < c else py - e if py > e else 0.0
                if dx * dx + dy * dy > best:
                    continue
                if k < inner:
                    # the half on this side of the other is looked at first
                    k, other = 2 * k + 1, 2 * k + 2
                    l, r = boxes[k], boxes[other]
                    nearer = abs(l[0] + l[1] - 2 * px) + abs(l[2] + l[3] - 2 * py) <= abs(r[0] + r[1] - 2 * px) + abs(r[2] + r[3] - 2 * py)
                    todo += (other, k) if nearer else (k, other)
                    continue
                for p in leaves[k - inner]:
                    dx, dy = x[p] - px, y[p] - py
                    d = dx * dx + dy * dy
                    if d < best or (d == best and p < found):
                        best, found = d, p
            node = (node - 1) >> 1
        at = found
        order.append(at)
    return order


def greedy_tier(rows: pd.DataFrame) -> pd.DataFrame:
    """A path from the point of least x + y, always to the nearest point left; ties to the lowest id.

    Arcs that start at one place follow each other by id, so the path is one over places,
    numbered by their lowest arc; a step searches a tree of them. Arcs without points come last, by id.
    """
    rows = rows.sort_values("arc_id")
    x, y = rows["sx"].to_numpy(float, na_value=np.nan) + 0.0, rows["sy"].to_numpy(float, na_value=np.nan) + 0.0
    placed = np.isfinite(x + y)
    some = np.flatnonzero(placed)
    order = np.empty(0, np.int64)
    if len(some):
        by = some[np.lexsort((some, y[some], x[some]))]
        new = np.concatenate(([True], (x[by[1:]] != x[by[:-1]]) | (y[by[1:]] != y[by[:-1]])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(by)))
        rank = np.argsort(by[first])  # places by their lowest arc
        path = rank[nearest_path(x[by[first]][rank], y[by[first]][rank])]
        # the arcs of each place, place by place
        size, first = size[path], first[path]
        ends = np.cumsum(size)
        order = by[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]
    order = np.concatenate([order, np.flatnonzero(~placed)])
    step = np.empty(len(rows), np.int64)
    step[order] = np.arange(len(rows))
    return rows.assign(step=step)[["arc_id", "ref_count", "outline", "step"]]


def hierarchical_greedy(arcs: DataFrame, arc_refs: DataFrame) -> DataFrame:
    """Each tier is a path by itself and each step follows from the one before, so a tier is one task, with some 100 bytes and 5 microseconds an arc."""
    tiers = keyed(arcs, arc_refs).select("arc_id", "ref_count", "outline", "sx", "sy")
    paths = tiers.groupBy("ref_count").applyInPandas(greedy_tier, "arc_id int, ref_count long, outline boolean, step long")
    return outline_first(paths, [F.desc("ref_count"), F.asc("step")])


def remap(arc_refs: DataFrame, permutation: DataFrame) -> DataFrame:
    """arc_refs with new arc ids; direction stays."""
    out = arc_refs.join(permutation, "arc_id").withColumn("arc_id", F.col("new_id").cast("int")).drop("new_id")
    return out.withColumn("arc_ref", S.signed_ref(F.col("arc_id"), F.col("forward")))
