import random

import pytest

from arcloom.operators import merge, neighbors
from arcloom.sources.topojson import geometries, read_topology, write_topology
import json


def topology(spark, arcs, **layers):
    return read_topology(spark, json.dumps({"type": "Topology", "arcs": arcs, "objects": {k: {"type": "GeometryCollection", "geometries": v} for k, v in layers.items()}}))


def polygon(*rings):
    return {"type": "Polygon", "arcs": list(rings)}


def select(spark, ids, layer="block"):
    return spark.createDataFrame([(1, 0, k, layer, i) for k, i in enumerate(ids)], "merge_id long, input_ord int, ord int, layer string, geom_id int")


def shape(t, spark, ids, layer="block"):
    rows = merge.merge(select(spark, ids, layer), t["arc_refs"], t["arcs"]).orderBy("poly_idx", "ring_idx").collect()
    out = {}
    for r in rows:
        assert r.coords[0] == r.coords[-1]
        out.setdefault(r.poly_idx, []).append((len(r.coords) - 1, r.area2))
    return list(out.values())


TWO = [[[0, 0], [1, 0]], [[1, 0], [1, 1]], [[1, 1], [0, 1]], [[0, 1], [0, 0]], [[1, 0], [2, 0]], [[2, 0], [2, 1]], [[2, 1], [1, 1]]]


def square(x, y, n):
    return [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]


def test_two_blocks(spark):
    t = topology(spark, TWO, block=[polygon([0, 1, 2, 3]), polygon([4, 5, 6, ~1])])
    assert shape(t, spark, [0, 1]) == [[(6, 4.0)]]
    assert shape(t, spark, []) == []
    assert shape(t, spark, [0, 0]) == []  # a repeated geometry cancels itself
    arcs = {r.arc_ref for r in merge.merge_arcs(select(spark, [0, 1]), t["arc_refs"], t["arcs"]).collect()}
    assert arcs == {0, 2, 3, 4, 5, 6}
    assert [r.neighbors for r in neighbors.neighbors(t["arc_refs"], t["features"]).orderBy("geom_id").collect()] == [[1], [0]]
    text = merge.geojson(merge.merge(select(spark, [0]), t["arc_refs"], t["arcs"])).first().geometry
    assert json.loads(text)["coordinates"] == [[[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]]


def test_disjoint_and_holes(spark):
    t = topology(spark, [square(0, 0, 1), square(3, 0, 1)], block=[polygon([0]), polygon([1])])
    assert shape(t, spark, [0, 1]) == [[(4, 2.0)], [(4, 2.0)]]
    t = topology(spark, [square(0, 0, 3), square(1, 1, 1)], block=[polygon([0], [1]), polygon([~1])])
    assert shape(t, spark, [0, 1]) == [[(4, 18.0)]]
    two = [[[3, 3], [3, 0]], [[3, 0], [0, 0], [0, 3], [3, 3]], square(1, 1, 1), [[3, 3], [6, 3], [6, 0], [3, 0]], square(4, 1, 1)]
    t = topology(spark, two, block=[polygon([0, 1], [2]), polygon([~0, 3], [4])])
    assert shape(t, spark, [0, 1]) == [[(6, 36.0), (4, 2.0), (4, 2.0)]]


def test_horseshoes(spark):
    arcs = [[[2, 3], [2, 2]], [[2, 2], [1, 2], [1, 1], [2, 1]], [[2, 1], [2, 0]], [[2, 0], [0, 0], [0, 3], [2, 3]], [[2, 1], [3, 1], [3, 2], [2, 2]], [[2, 3], [4, 3], [4, 0], [2, 0]], [[2, 2], [2, 1]]]
    blocks = [polygon([0, 1, 2, 3]), polygon([~2, 4, ~0, 5]), polygon([6, ~1]), polygon([~6, ~4])]
    t = topology(spark, arcs, block=blocks)
    assert shape(t, spark, [0, 1]) == [[(6, 24.0), (6, 4.0)]]
    assert shape(t, spark, [0, 1, 2, 3]) == [[(6, 24.0)]]


def test_island_and_layers(spark):
    land = {"type": "MultiPolygon", "arcs": [[[0], [1]], [[2]]]}
    t = topology(spark, [square(0, 0, 10), square(2, 2, 6), square(4, 4, 2)], land=[land, {"type": "Point"}])
    assert sorted(len(p) for p in shape(t, spark, [0], "land")) == [1, 2]
    assert geometries(t["arc_refs"], t["features"]).where("geom_id = 1").first().arcs == []
    with pytest.raises(ValueError):
        merge.checked(select(spark, [7], "land"), t["features"])
    again = read_topology(spark, write_topology(t))
    assert again["arc_refs"].orderBy("geom_id", "poly_idx", "ring_idx", "pos").collect() == t["arc_refs"].orderBy("geom_id", "poly_idx", "ring_idx", "pos").collect()


def test_neighbors_plus(spark):
    arcs = [[[k, 0], [k, 1]] for k in range(8)]
    t = topology(spark, arcs, block=[polygon([0, 1, 2, 3]), polygon([~2, 6]), polygon([4, ~0, 5]), polygon([7, ~1])])
    for mode in ("first", "all"):
        assert [r.neighbors for r in neighbors.neighbors(t["arc_refs"], t["features"], mode).orderBy("geom_id").collect()] == [[1, 2, 3], [0], [0], [0]]


def test_same_result_by_component(spark, sf):
    from arcloom.sources.grid import grid

    g = grid(spark, sf)
    a = merge.merge_arcs(g.selection, g.arc_refs, g.arcs).collect()
    b = merge.merge_arcs_by_component(g.selection, g.arc_refs, g.arcs).collect()
    assert sorted(a) == sorted(b) and len(a) > 400


def test_stitch_uses_each_arc_once():
    rng = random.Random(7)
    for _ in range(2000):
        n = rng.randint(1, 40)
        refs = [k if rng.random() < 0.5 else ~k for k in rng.sample(range(100), n)]
        a, b = [rng.randint(0, 12) for _ in refs], [rng.randint(0, 12) for _ in refs]
        ends = dict(zip(refs, zip(a, b)))
        rings = merge.stitch(refs, a, b)
        assert sorted(r for ring in rings for r in ring) == sorted(refs)
        for ring in rings:
            assert all(ends[x][1] == ends[y][0] for x, y in zip(ring, ring[1:]))


def test_stitch_chain():
    n = 300
    assert merge.stitch(list(range(n))[::-1], list(range(n))[::-1], list(range(1, n + 1))[::-1]) == [list(range(n))]


def test_open_chain_closes(spark):
    t = topology(spark, [[[0, 0], [4, 0]], [[4, 0], [4, 4]], [[4, 4], [0, 4], [0, 2]]], block=[polygon([0, 1, 2])])
    assert shape(t, spark, [0]) == [[(4, 32.0)]]
