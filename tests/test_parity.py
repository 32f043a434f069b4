"""Behaviour that has to be kept exactly: order of rings, adjacency of more than two users, orders of arcs, the container's sections."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.operators import merge, neighbors, order
from arcloom.plans import registry
from arcloom.sources import container
from arcloom.sources.topojson import read_topology, write_topology


def topology(spark, arcs, **layers):
    return read_topology(spark, json.dumps({"type": "Topology", "arcs": arcs, "objects": {k: {"type": "GeometryCollection", "geometries": v} for k, v in layers.items()}}))


def polygon(*rings):
    return {"type": "Polygon", "arcs": list(rings)}


@pytest.mark.parametrize("name", ["merge_by_nation", "merge_arcs_by_nation", "merge_arcs_boundary_only", "merge_geojson", "neighbors_shared", "neighbors_shared_all", "order_hilbert", "offsets_unequal", "blocks_unequal", "fetch_arcs", "arcs_bbox", "container_endpoints", "container_pruned_scan", "container_roundtrip", "container_arcs_by_id", "rewrite_property", "topojson_roundtrip"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(want.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want) and len(got)


def naive_stitch(refs, starts, ends):
    """Fragments in a list, looked up by walking it: the fragment that ends where a reference starts, else the one that starts where it ends."""
    pieces, by_end, by_start = [], {}, {}
    for r, a, b in zip(refs, starts, ends):
        if a in by_end:
            p = by_end.pop(a)
            p["refs"] = p["refs"] + [r]
            p["b"] = b
            if b in by_start:
                q = by_start.pop(b)
                if q is not p:
                    by_end.pop(q["b"], None)
                    by_start.pop(p["a"], None)
                    p["refs"], p["b"] = p["refs"] + q["refs"], q["b"]
                by_start[p["a"]] = p
            by_end[p["b"]] = p
        elif b in by_start:
            p = by_start.pop(b)
            p["refs"], p["a"] = [r] + p["refs"], a
            by_start[a] = p
        else:
            p = {"refs": [r], "a": a, "b": b}
            by_start[a] = by_end[b] = p
    for p in [*by_end.values(), *by_start.values()]:
        if not any(p is q for q in pieces):
            pieces.append(p)
    rings = [p["refs"] for p in pieces]
    used = {r for ring in rings for r in ring}
    return rings + [[r] for r in refs if r not in used]


def test_stitch_order_of_rings():
    rng = random.Random(11)
    for _ in range(5000):
        n = rng.randint(1, 40)
        refs = [k if rng.random() < 0.5 else ~k for k in rng.sample(range(100), n)]
        a, b = [rng.randint(0, 11) for _ in refs], [rng.randint(0, 11) for _ in refs]
        assert merge.stitch(refs, a, b) == naive_stitch(refs, a, b)


def test_far_points_do_not_collide():
    far = (0.0, 2.0**26)
    tri = lambda p, q, r: ([p, q, r], [q, r, p])
    (a1, b1), (a2, b2) = tri((1.0, 0.0), (5.0, 0.0), (5.0, 5.0)), tri(far, (9.0, 9.0), (8.0, 9.0))
    rings = merge.stitch(list(range(6)), [*a1, *a2], [*b1, *b2])
    assert [set(r) for r in rings] == [{0, 1, 2}, {3, 4, 5}]


def test_neighbors_of_more_than_two(spark):
    line = [[[k, 0], [k, 1]] for k in range(4)]
    t = topology(spark, line, block=[polygon([0, 1]), polygon([2, ~0]), polygon([3])])
    assert [r.neighbors for r in neighbors.neighbors(t["arc_refs"], t["features"]).orderBy("geom_id").collect()] == [[1], [0], []]
    t = topology(spark, line, block=[polygon([0]), polygon([0])])
    assert [r.neighbors for r in neighbors.neighbors(t["arc_refs"], t["features"]).orderBy("geom_id").collect()] == [[], [0]]
    t = topology(spark, line, block=[polygon([0]), polygon([0]), polygon([~0]), polygon([~0])])
    first, every = ([r.neighbors for r in neighbors.neighbors(t["arc_refs"], t["features"], m).orderBy("geom_id").collect()] for m in ("first", "all"))
    assert first == [[2], [0], [0], [0]] and every == [[1, 2, 3], [0], [0], [0]]


def test_hilbert_of_two_layers(spark):
    """FIXTURES.md, F-ORDER."""
    arcs = [[[10 * (k + 1), 0], [10 * (k + 1), 1]] for k in range(8)]
    t = topology(spark, arcs, block=[polygon(r) for r in ([6, 0], [~6, 4, 1], [7, ~4, 2], [~7, 5, 3])], county=[polygon([0, 4, 2, ~5]), polygon([~5, 1, 4, ~3])])
    found = order.arc_order(t["arc_refs"], t["arcs"], "hilbert", ["block", "county"])
    assert [r.arc_id for r in found.orderBy("new_id").collect()] == [0, 4, 2, 5, 1, 3, 6, 7]
    back = {r.arc_id: r.new_id for r in order.inverted(found).collect()}
    assert all(back[r.new_id] == r.arc_id for r in found.collect())
    with pytest.raises(ValueError, match="no order"):
        order.arc_order(t["arc_refs"], t["arcs"], "zorder")


def test_greedy_path_equals_a_scan():
    import pandas as pd

    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 300):
        x, y = rng.integers(0, 40, n).astype(float), rng.integers(0, 9, n).astype(float)
        rows = pd.DataFrame({"arc_id": np.arange(n), "ref_count": 1, "outline": False, "sx": x, "sy": y})
        left, at, path = set(range(n)), int(np.argmin(x + y)), []
        while True:
            path.append(at)
            left.discard(at)
            if not left:
                break
            at = min(left, key=lambda k: ((x[k] - x[at]) ** 2 + (y[k] - y[at]) ** 2, k))  # noqa: B023
        assert order.greedy_tier(rows).sort_values("step")["arc_id"].tolist() == path


def test_greedy_path_over_long_and_crowded_tiers():
    import time

    import pandas as pd

    def tier(x, y):
        rows = pd.DataFrame({"arc_id": np.arange(len(x)), "ref_count": 2, "outline": False, "sx": x, "sy": y})
        return order.greedy_tier(rows).sort_values("step")["arc_id"].tolist()

    # far longer than wide, two arcs a place; nearly all in one corner of the box
    began, k = time.time(), np.arange(120_000)
    assert len(set(tier((k // 2) % 25 + 0.0, (k // 50) + 0.0))) == len(k)
    corner = np.where(k == 7, 1e9, (k * 7919) % 65_537 / 65_537)
    assert tier(corner, np.zeros(len(k))) == sorted(range(len(k)), key=lambda i: (corner[i], i))
    assert time.time() - began < 20
    # arcs without points, and a tier of nothing else
    assert tier(np.array([np.nan, 5.0, 1.0, np.nan, 4.0]), np.array([np.nan, 0.0, 0.0, np.nan, 0.0])) == [2, 4, 1, 0, 3]
    assert tier(np.full(3, np.nan), np.full(3, np.nan)) == [0, 1, 2]


def test_polygons_without_rings_are_skipped(spark):
    """A component that cancels as a whole gives no polygon; the others keep their order."""
    tri = lambda k: [[[k, 0], [k + 1, 0]], [[k + 1, 0], [k, 1]], [[k, 1], [k, 0]]]
    t = topology(spark, [a for k in (0, 10, 20) for a in tri(k)], block=[polygon([0, 1, 2]), polygon([3, 4, 5]), polygon([6, 7, 8])])
    sel = spark.createDataFrame([(1, 0, n, "block", g) for n, g in enumerate([0, 1, 1, 2])], "merge_id long, input_ord int, ord int, layer string, geom_id int")
    for f in (merge.merge_arcs, merge.merge_arcs_by_component, lambda *a: merge.merge_arcs_by_component(*a, walk=False)):
        assert sorted((r.poly_idx, r.arc_ref) for r in f(sel, t["arc_refs"], t["arcs"]).collect()) == [(0, 0), (0, 1), (0, 2), (1, 6), (1, 7), (1, 8)]
    with pytest.raises(ValueError, match="unknown"):
        merge.merge(sel.withColumn("geom_id", F.lit(9)), t["arc_refs"], t["arcs"], t["features"])


def test_container_sections(spark, tmp_path):
    arcs = [[[0, 0], [1000, 0]], [[1000, 0], [0, 1000], [0, -1000]], [[5, 5], [7, 7]]]
    text = json.dumps({"type": "Topology", "transform": {"scale": [1, 1], "translate": [0, 0]}, "arcs": arcs, "objects": {"region": {"type": "GeometryCollection", "geometries": [
        {"type": "MultiPolygon", "arcs": [[[0, 1]], [[2]]], "properties": {"id": "M", "stats": {"pop": 5, "vap": 3}}}, {"type": "Polygon", "arcs": [[~2]], "properties": {"id": "P", "stats": {"pop": 9, "vap": 8}}}]}}})
    t = read_topology(spark, text)
    grid = {"scale": [1, 1], "translate": [0, 0]}
    a, b, plain = (str(tmp_path / x) for x in "abc")
    container.write_container(t, a, grid)
    assert container.Container(a).has_endpoints()
    container.write_container(t, plain, grid, endpoints=False)
    ends = [container.read_container(spark, x, "endpoints").orderBy("arc_id").collect() for x in (a, plain)]
    assert ends[0] == ends[1] and [tuple(r)[1:] for r in ends[0]] == [(0, 0, 1000, 0), (1000, 0, 1000, 0), (5, 5, 12, 12)]
    back = container.decode_container(spark, a)
    assert back["arc_refs"].orderBy("geom_id", "poly_idx", "pos").collect() == t["arc_refs"].orderBy("geom_id", "poly_idx", "pos").collect()
    kept = [(r.geom_type, json.loads(r.properties)) for r in back["features"].orderBy("geom_id").collect()]
    assert kept == [("MultiPolygon", {"id": "M", "stats": {"pop": 5, "vap": 3}}), ("Polygon", {"id": "P", "stats": {"pop": 9, "vap": 8}})]
    container.write_container(back, b, grid)
    assert open(a, "rb").read() == open(b, "rb").read()  # decoding and writing again changes nothing
    assert json.loads(write_topology(back))["objects"]["region"]["geometries"][1]["arcs"] == [[-3]]


def test_filters_reach_the_source(spark, tmp_path):
    arcs = spark.range(5000).select(F.col("id").cast("int").alias("arc_id"), F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))).alias("points"))
    none = {"arc_refs": spark.createDataFrame([], container.REFS), "features": spark.createDataFrame([], "layer string, geom_id int, properties string")}
    path = str(tmp_path / "f")
    container.write_container({"arcs": arcs, **none}, path, {"scale": [1, 1], "translate": [0, 0]}, target=512)
    blocks = len(container.Container(path).arc_blocks())
    reader = container.PushingReader({"path": path, "table": "arcs"})
    assert sum(len(p.frames) for p in reader.partitions()) == blocks > 20
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

    reader.narrow([GreaterThanOrEqual(("arc_id",), 100), LessThan(("arc_id",), 200)])
    assert 0 < sum(len(p.frames) for p in reader.partitions()) < 6
    reader.narrow([In(("arc_id",), (150, 4000))])
    assert sum(len(p.frames) for p in reader.partitions()) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for table in ("arcs", "endpoints"):
            df = container.read_container(spark, path, table)
            assert [r.arc_id for r in df.where("arc_id IN (7, 4999, 9999)").select("arc_id").orderBy("arc_id").collect()] == [7, 4999]
            assert df.where("arc_id > 10 AND arc_id <= 20 AND sx <> 15").count() == 9
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="missing"):
        c = container.Container(path)
        c.sections.pop("arc_offsets")
        c.check()


def test_streamed_selections(spark, tmp_path):
    from arcloom.streaming.merges import stream_merges

    square = [[[0, 0], [1, 0]], [[1, 0], [1, 1]], [[1, 1], [0, 1]], [[0, 1], [0, 0]]]
    t = topology(spark, square, block=[polygon([0, 1, 2, 3])])
    selection = spark.createDataFrame([(1, 0, 0, "block", 0)], "merge_id long, input_ord int, ord int, layer string, geom_id int")
    selection.write.parquet(str(tmp_path / "in"))
    stream = stream_merges(spark.readStream.schema(selection.schema).parquet(str(tmp_path / "in")), t["arc_refs"], t["arcs"], str(tmp_path / "out"), str(tmp_path / "state"))
    stream.processAllAvailable()
    stream.stop()
    assert [(r.merge_id, r.area2) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2.0)]
