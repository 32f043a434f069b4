import json

import pytest
from pyspark.sql import functions as F

from arcloom.functions import ordered
from arcloom.functions import scalar as S
from arcloom.operators import blocks, order, props
from arcloom.plans import registry
from arcloom.sources.topojson import read_topology


def test_hilbert_visits_each_cell_once(spark):
    cells = spark.range(256).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y"))
    rows = cells.select("x", "y", S.hilbert_key(F.col("x"), F.col("y"), 16).alias("k")).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_arc_orders(spark):
    arcs = [[[10 * (k + 1), 0], [10 * (k + 1), 1]] for k in range(8)]
    block = [[6, 0], [~6, 4, 1], [7, ~4, 2], [~7, 5, 3]]
    county = [[0, 4, 2, ~5], [~5, 1, 4, ~3]]
    layers = {n: {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "arcs": [r]} for r in rings]} for n, rings in (("block", block), ("county", county))}
    t = read_topology(spark, json.dumps({"arcs": arcs, "objects": layers}))
    found = order.hierarchical_hilbert(t["arcs"], t["arc_refs"]).orderBy("new_id").collect()
    assert [r.arc_id for r in found] == [4, 5, 0, 1, 2, 3, 6, 7]
    for f in (order.hierarchical_str, order.hierarchical_greedy):
        assert {r.arc_id for r in f(t["arcs"], t["arc_refs"]).where("new_id < 2").collect()} == {4, 5}
    back = order.remap(t["arc_refs"], order.hierarchical_hilbert(t["arcs"], t["arc_refs"]))
    assert back.where("forward").count() == t["arc_refs"].where("forward").count()


def test_varints(spark):
    values = [0, 1, -1, 63, -64, 64, -65, 127, -128, 8191, -8192, 1 << 20, -(1 << 20), 2**28 - 1, -(2**28), 2**31 - 1, -(2**31)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.unzigzag(S.zigzag(F.col("v"))).alias("b"), S.varint_length(F.col("v")).alias("n")).collect()
    assert all(r.v == r.b for r in rows)
    assert {r.v: r.n for r in rows}[63] == 1 and {r.v: r.n for r in rows}[64] == 2 and {r.v: r.n for r in rows}[-(2**31)] == 5


def test_packing():
    assert blocks.pack([3000, 1000, 200, 9000, 1, 4096]) == [0, 0, 1, 2, 3, 4]


def test_prefix_sums_and_ranks_cross_blocks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    rows = ordered.prefix_sum(df, "id", F.col("v"), "s", block=64).orderBy("id").collect()
    assert [r.s for r in rows] == [sum(k % 7 for k in range(n)) for n in range(1000)]
    rows = ordered.ranked(df, [F.desc("v"), F.asc("id")], "r", 5).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.r)] == sorted(range(1000), key=lambda k: (-(k % 7), k))


def test_properties(spark):
    df = spark.createDataFrame([(1, -3, 1.5, "a", None, True), (255, 300, 2.0, None, None, False)], "a long, b long, c double, d string, e long, f boolean")
    assert {r.name: r.dtype for r in props.dtype_profile(df, df.columns).collect()} == {"a": "u8", "b": "i16", "c": "f64", "d": "strings", "e": "strings", "f": "u8"}
    wide = spark.createDataFrame([(float("nan"), 5_000_000_000)], "x double, y long")
    assert {r.name: r.dtype for r in props.dtype_profile(wide, ["x", "y"]).collect()} == {"x": "f64", "y": "u32"}
    assert props.with_defaults(df, ["d", "e"]).orderBy("a").collect()[1][3:5] == ("", 0)
    with pytest.raises(ValueError):
        props.override(df, "zz", df)


def test_registry_has_sql_for_most():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.oracle_sql()) >= 40


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
