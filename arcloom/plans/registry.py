"""The queries of the topology operators and their SQL.

Each query runs over its whole tables; the topology is derived from `customer`
(arcloom.sources.grid). SQL is DuckDB's and computes the same rows another way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.ordered import prefix_sum
from ..operators import blocks, merge, neighbors, order, props
from ..sources.container import decode_container, read_container, rewrite_container, write_container
from ..sources.grid import WIDTH, grid, refs_of, tile_selection
from ..sources.topojson import load_topology, save_topology
from ..storage import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The grid in SQL: its height, cells and references.
GRID = """WITH hh AS (SELECT (count(*) // 25)::INT AS h FROM customer),
cells AS (SELECT c_custkey::INT AS g, (c_custkey % 25)::INT AS x, (c_custkey // 25)::INT AS y, c_nationkey::BIGINT AS nation, c_name, c_acctbal, c_mktsegment FROM customer),
ring AS (SELECT g, x, y, nation, unnest([0, 1, 2, 3]) AS pos FROM cells),
refs AS (SELECT g AS geom_id, x, y, nation, pos, CASE pos WHEN 0 THEN y * 25 + x WHEN 1 THEN (h + 1) * 25 + y * 26 + x + 1 WHEN 2 THEN -((y + 1) * 25 + x) - 1 ELSE -((h + 1) * 25 + y * 26 + x) - 1 END AS arc_ref FROM ring, hh),
r AS (SELECT *, CASE WHEN arc_ref < 0 THEN -arc_ref - 1 ELSE arc_ref END AS arc_id, arc_ref >= 0 AS forward FROM refs),
arcs AS (SELECT k::INT AS arc_id, (CASE WHEN k < (h + 1) * 25 THEN k % 25 ELSE (k - (h + 1) * 25) % 26 END)::DOUBLE AS sx, (CASE WHEN k < (h + 1) * 25 THEN k // 25 ELSE (k - (h + 1) * 25) // 26 END)::DOUBLE AS sy, (CASE WHEN k < (h + 1) * 25 THEN k % 25 + 1 ELSE (k - (h + 1) * 25) % 26 END)::DOUBLE AS ex, (CASE WHEN k < (h + 1) * 25 THEN k // 25 ELSE (k - (h + 1) * 25) // 26 + 1 END)::DOUBLE AS ey FROM hh, range((SELECT (h + 1) * 25 + h * 26 FROM hh)) t(k))
"""


def query(sql: str | None = None, on_grid: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (GRID if on_grid else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs(g) -> DataFrame:
    return merge.expand(g.selection, g.arc_refs)


@query("SELECT 'cell' AS layer, geom_id, 0 AS poly_idx, 0 AS ring_idx, pos, arc_ref, arc_id, forward FROM r")
def grid_arc_refs(spark, d):
    return grid(spark, d).arc_refs


@query("SELECT arc_id, 2 AS n_points, sx, sy, ex, ey FROM arcs")
def grid_arcs(spark, d):
    return grid(spark, d).arcs.select("arc_id", F.size("points").alias("n_points"), F.col("points")[0]["x"].alias("sx"), F.col("points")[0]["y"].alias("sy"), F.element_at("points", -1)["x"].alias("ex"), F.element_at("points", -1)["y"].alias("ey"))


@query("SELECT arc_id, sx, sy, ex, ey FROM arcs")
def grid_endpoints(spark, d):
    return grid(spark, d).arcs.select("arc_id", "sx", "sy", "ex", "ey")


@query("SELECT 'cell' AS layer, count(DISTINCT geom_id) AS n_geoms, count(*) AS n_refs, count(DISTINCT arc_id) AS n_arcs FROM r")
def layer_summary(spark, d):
    return grid(spark, d).arc_refs.groupBy("layer").agg(F.countDistinct("geom_id").alias("n_geoms"), F.count("*").alias("n_refs"), F.countDistinct("arc_id").alias("n_arcs"))


@query("SELECT geom_id, 4 AS n_refs, (geom_id * 4)::BIGINT AS ref_offset FROM (SELECT DISTINCT geom_id FROM r)")
def csr_offsets(spark, d):
    per = grid(spark, d).arc_refs.groupBy("geom_id").agg(F.count("*").cast("int").alias("n_refs"))
    return prefix_sum(per, "geom_id", F.col("n_refs"), "ref_offset")


@query("SELECT nation AS geom_id, (row_number() OVER (PARTITION BY nation ORDER BY g) - 1)::INT AS poly_idx, g AS cell FROM cells QUALIFY poly_idx > 0")
def poly_breaks(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("geom_id")
    return grid(spark, d).features.select(F.col("c_nationkey").cast("long").alias("geom_id"), (F.row_number().over(w) - 1).alias("poly_idx"), F.col("geom_id").alias("cell")).where("poly_idx > 0")


@query("SELECT g AS geom_id, c_acctbal FROM cells")
def property_scan(spark, d):
    return grid(spark, d).features.select("geom_id", "c_acctbal")


@query("SELECT g AS geom_id, c_name, length(c_name)::INT AS n FROM cells")
def strings_scan(spark, d):
    return grid(spark, d).features.select("geom_id", "c_name", F.length("c_name").alias("n"))


@query("SELECT unnest(['p_size', 'p_partkey', 'p_retailprice', 'p_name']) AS name, unnest([CASE WHEN max(p_size) <= 255 AND min(p_size) >= 0 THEN 'u8' ELSE 'other' END, CASE WHEN max(p_partkey) <= 255 THEN 'u8' WHEN max(p_partkey) <= 65535 THEN 'u16' ELSE 'u32' END, CASE WHEN bool_and(p_retailprice = floor(p_retailprice)) THEN CASE WHEN max(p_retailprice) <= 255 THEN 'u8' WHEN max(p_retailprice) <= 65535 THEN 'u16' ELSE 'u32' END ELSE 'f64' END, 'strings']) AS dtype FROM part", False)
def property_dtype(spark, d):
    return props.dtype_profile(table(spark, d, "part"), ["p_size", "p_partkey", "p_retailprice", "p_name"])


ORDERS = "(SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)"


@query(f"SELECT c_custkey::INT AS geom_id, coalesce(n_orders, 0) AS n_orders FROM customer LEFT JOIN {ORDERS} ON o_custkey = c_custkey", False)
def property_defaults(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("int").alias("geom_id")).agg(F.count("*").alias("n_orders"))
    return props.with_defaults(grid(spark, d).features.select("geom_id").join(n, "geom_id", "left"), ["n_orders"])


@query(f"SELECT c_custkey::INT AS geom_id, coalesce(n_orders, 0)::DOUBLE AS c_acctbal FROM customer LEFT JOIN {ORDERS} ON o_custkey = c_custkey", False)
def property_override(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("int").alias("geom_id")).agg(F.count("*").cast("double").alias("c_acctbal"))
    return props.override(grid(spark, d).features.select("geom_id", "c_acctbal"), "c_acctbal", n, 0.0)


@query("SELECT c_custkey::INT AS geom_id, c_name, c_mktsegment FROM customer", False)
def property_nested(spark, d):
    f = grid(spark, d).features.select("geom_id", F.col("c_name").alias("who/name"), F.col("c_mktsegment").alias("who/segment"))
    back = props.flatten(props.nest(f, ["who/name", "who/segment"]))
    return back.select("geom_id", F.col("`who/name`").alias("c_name"), F.col("`who/segment`").alias("c_mktsegment"))


@query("SELECT arc_id, sx, sy, ex, ey FROM arcs WHERE arc_id IN (SELECT arc_id FROM r GROUP BY arc_id HAVING count(DISTINCT nation) > 1)")
def fetch_arcs(spark, d):
    """The arcs between nations: ids derived from all references."""
    g = grid(spark, d)
    ids = refs(g).groupBy("arc_id").agg(F.count_distinct("merge_id").alias("n")).where("n > 1").select("arc_id")
    return g.arcs.join(ids, "arc_id", "left_semi").select("arc_id", F.col("points")[0]["x"].alias("sx"), F.col("points")[0]["y"].alias("sy"), F.element_at("points", -1)["x"].alias("ex"), F.element_at("points", -1)["y"].alias("ey"))


@query("SELECT arc_id, sx, sy, ex, ey FROM arcs WHERE arc_id IN (SELECT arc_id FROM r)")
def fetch_arc_endpoints(spark, d):
    g = grid(spark, d)
    return g.arcs.select("arc_id", "sx", "sy", "ex", "ey").join(g.arc_refs.select("arc_id").distinct(), "arc_id", "left_semi")


@query("SELECT arc_id, 32 AS byte_len, arc_id::BIGINT * 32 AS byte_offset FROM arcs")
def arc_offsets(spark, d):
    sized = grid(spark, d).arcs.select("arc_id", (F.size("points") * 16).alias("byte_len"))
    return prefix_sum(sized, "arc_id", F.col("byte_len"), "byte_offset")


VALUES = "(SELECT o_orderkey::BIGINT AS k, (o_orderkey * 2654435761 % 4294967296)::BIGINT AS v FROM orders)"


def _values(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.pmod(F.col("o_orderkey").cast("long") * 2654435761, F.lit(S.MOD)).alias("v"))


@query(f"SELECT a.k, a.v, ((a.v - coalesce(b.v, 0) + 4294967296) % 4294967296)::BIGINT AS delta FROM {VALUES} a LEFT JOIN {VALUES} b ON b.k = a.k - 1", False)
def delta_encode(spark, d):
    return blocks.delta_encode(_values(spark, d), "k", "v")


@query(f"SELECT k, v, (sum(v) OVER (ORDER BY k) % 4294967296)::BIGINT AS value FROM {VALUES}", False)
def delta_decode(spark, d):
    return blocks.delta_decode(_values(spark, d).withColumn("delta", F.col("v")), "k").drop("delta")


@query("SELECT o_orderkey::BIGINT AS k, (CASE WHEN o_orderkey % 2 = 0 THEN 2 * o_orderkey ELSE 2 * o_orderkey - 1 END)::BIGINT AS z, (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END)::BIGINT AS back FROM orders", False)
def zigzag(spark, d):
    v = F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(-F.col("k"))
    return _values(spark, d).select("k", S.zigzag(v).alias("z"), S.unzigzag(S.zigzag(v)).alias("back"))


@query("SELECT o_orderkey::BIGINT AS k, (CASE WHEN o_orderkey < 64 THEN 1 WHEN o_orderkey < 8192 THEN 2 WHEN o_orderkey < 1048576 THEN 3 ELSE 4 END)::INT AS n FROM orders", False)
def varint_length(spark, d):
    return _values(spark, d).select("k", S.varint_length(F.col("k")).alias("n"))


@query("SELECT arc_id, sx * 0.5 + 10.0 AS x, sy * 0.25 + 20.0 AS y FROM arcs")
def transform_points(spark, d):
    return grid(spark, d).arcs.select("arc_id", S.transform(F.col("sx"), F.col("sy"), (0.5, 0.25), (10, 20)).alias("p")).select("arc_id", "p.*")


@query("SELECT arc_id, (sx - 10.0) / 0.5 AS x, (sy - 20.0) / 0.25 AS y FROM arcs")
def untransform_points(spark, d):
    return grid(spark, d).arcs.select("arc_id", S.untransform(F.col("sx"), F.col("sy"), (0.5, 0.25), (10, 20)).alias("p")).select("arc_id", "p.*")


@query("SELECT geom_id, pos, CASE WHEN forward THEN sx ELSE ex END AS x, CASE WHEN forward THEN sy ELSE ey END AS y FROM r JOIN arcs USING (arc_id)")
def ref_directed_endpoints(spark, d):
    g = grid(spark, d)
    first = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    return g.arc_refs.join(g.arcs, "arc_id").select("geom_id", "pos", first("sx", "ex").alias("x"), first("sy", "ey").alias("y"))


@query("SELECT nation AS merge_id, arc_id, count(*) AS n FROM r GROUP BY 1, 2")
def arc_membership(spark, d):
    return merge.membership(refs(grid(spark, d)))


@query("SELECT nation AS merge_id, arc_id, min(arc_ref) AS arc_ref FROM r GROUP BY 1, 2 HAVING count(*) = 1")
def boundary_arcs(spark, d):
    return merge.boundary(refs(grid(spark, d))).select("merge_id", "arc_id", "arc_ref")


COMPONENTS = """, e AS (SELECT DISTINCT a.nation, a.geom_id AS a, b.geom_id AS b FROM r a JOIN r b ON a.arc_id = b.arc_id AND a.nation = b.nation AND a.geom_id <> b.geom_id),
w AS (WITH RECURSIVE t(node, root) AS (SELECT g, g FROM cells UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node WHERE t.root < e.b) SELECT node, min(root) AS root FROM t GROUP BY node)
"""


@query(COMPONENTS + "SELECT nation AS merge_id, g AS geom_id, root FROM cells JOIN w ON node = g")
def merge_components(spark, d):
    return merge.polygon_components(refs(grid(spark, d))).select("merge_id", F.col("ord").alias("geom_id"), F.col("root.ord").alias("root"))


@query(COMPONENTS + "SELECT n, count(*) AS components FROM (SELECT root, count(*) AS n FROM w GROUP BY root) GROUP BY n")
def component_sizes(spark, d):
    c = merge.polygon_components(refs(grid(spark, d)))
    return c.groupBy("root").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"))


@query("SELECT nation AS merge_id, count(*) AS n_arcs, 0 AS n_boundary FROM (SELECT DISTINCT nation, arc_id FROM r) GROUP BY nation")
def merge_duplicates_cancel(spark, d):
    g = grid(spark, d)
    twice = merge.membership(merge.expand(g.selection.unionByName(g.selection.withColumn("input_ord", F.lit(1))), g.arc_refs))
    return twice.groupBy("merge_id").agg(F.count("*").alias("n_arcs"), F.count_if(F.col("n") == 1).cast("int").alias("n_boundary"))


@query("SELECT nation AS merge_id, arc_id, count(*) + 1 AS n FROM r WHERE arc_id IN (SELECT arc_id FROM r WHERE geom_id = 0) GROUP BY 1, 2 UNION ALL SELECT nation, arc_id, count(*) FROM r WHERE arc_id NOT IN (SELECT arc_id FROM r WHERE geom_id = 0) GROUP BY 1, 2 UNION ALL SELECT m, arc_id, 1 FROM (SELECT DISTINCT nation AS m FROM r) CROSS JOIN (SELECT arc_id FROM r WHERE geom_id = 0) WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.nation = m AND q.arc_id = r.arc_id)".replace("(SELECT arc_id FROM r WHERE geom_id = 0) WHERE NOT", "(SELECT arc_id FROM r WHERE geom_id = 0) z WHERE NOT").replace("q.arc_id = r.arc_id", "q.arc_id = z.arc_id"))
def merge_multi_layer(spark, d):
    g = grid(spark, d)
    extra = refs_of(g.features.where("geom_id = 0"), g.height, "extra", F.lit(0), F.lit(0))
    more = g.selection.select("merge_id").distinct().select("merge_id", F.lit(1).alias("input_ord"), F.lit(0).alias("ord"), F.lit("extra").alias("layer"), F.lit(0).alias("geom_id"))
    return merge.membership(merge.expand(g.selection.unionByName(more), g.arc_refs.unionByName(extra)))


@query("SELECT 0::BIGINT AS merge_id, 0 AS poly_idx, 0 AS ring_idx WHERE false", False)
def merge_empty(spark, d):
    g = grid(spark, d)
    return merge.merge(g.selection.where("false"), g.arc_refs, g.arcs).select("merge_id", "poly_idx", "ring_idx")


TILES = """, t AS (SELECT ((y // 5) * 5 + x // 5)::BIGINT AS merge_id, count(DISTINCT x)::INT AS w, count(DISTINCT y)::INT AS hh FROM cells GROUP BY 1)
"""


@query(TILES + "SELECT merge_id, 0 AS poly_idx, 0 AS ring_idx, true AS is_exterior, 2 * (w + hh) + 1 AS n_points, (2 * w * hh)::DOUBLE AS area2 FROM t")
def merge_by_tile(spark, d):
    g = grid(spark, d)
    return merge.merge(tile_selection(g), g.arc_refs, g.arcs).select("merge_id", "poly_idx", "ring_idx", "is_exterior", F.size("coords").alias("n_points"), "area2")


@query(TILES + "SELECT merge_id, 0 AS poly_idx, 0 AS ring_idx, (2 * (w + hh))::BIGINT AS n_arcs FROM t")
def merge_arcs_by_tile(spark, d):
    g = grid(spark, d)
    return merge.merge_arcs(tile_selection(g), g.arc_refs, g.arcs).groupBy("merge_id", "poly_idx", "ring_idx").agg(F.count("*").alias("n_arcs"))


@query(TILES + "SELECT merge_id, 0 AS poly_idx, 0 AS ring_idx, (2 * (w + hh))::BIGINT AS n_arcs FROM t")
def merge_arcs_by_component(spark, d):
    g = grid(spark, d)
    return merge.merge_arcs_by_component(tile_selection(g), g.arc_refs, g.arcs).groupBy("merge_id", "poly_idx", "ring_idx").agg(F.count("*").alias("n_arcs"))


@query("SELECT nation AS merge_id, (2 * count(*))::DOUBLE AS area2 FROM cells GROUP BY nation")
def merge_area(spark, d):
    g = grid(spark, d)
    rings = merge.ring_coords(merge.merge_arcs(g.selection, g.arc_refs, g.arcs), g.arcs)
    return rings.groupBy("merge_id").agg(F.sum(S.signed_area2(F.col("coords"))).alias("area2"))


#: Rings of the merges by nation, walked arc by arc from each boundary reference; `root` is the component.
RINGS = COMPONENTS + """, once AS (SELECT nation, arc_id FROM r GROUP BY 1, 2 HAVING count(*) = 1),
b AS (SELECT r.nation, root, r.arc_id, r.arc_ref, CASE WHEN forward THEN sx ELSE ex END AS ax, CASE WHEN forward THEN sy ELSE ey END AS ay, CASE WHEN forward THEN ex ELSE sx END AS vx, CASE WHEN forward THEN ey ELSE sy END AS vy
  FROM r JOIN once USING (nation, arc_id) JOIN arcs USING (arc_id) JOIN w ON node = r.geom_id),
tour AS (WITH RECURSIVE t(nation, root, first, cur, vx, vy, k) AS (SELECT nation, root, arc_ref, arc_ref, vx, vy, 0 FROM b UNION ALL
  SELECT t.nation, t.root, t.first, b.arc_ref, b.vx, b.vy, k + 1 FROM t JOIN b ON b.nation = t.nation AND b.root = t.root AND b.ax = t.vx AND b.ay = t.vy WHERE b.arc_ref <> t.first) SELECT * FROM t),
least AS (SELECT nation, root, first, min(CASE WHEN cur < 0 THEN -cur - 1 ELSE cur END) AS arc FROM tour GROUP BY 1, 2, 3),
loops AS (SELECT t.nation, t.root, t.first, string_agg(cur::VARCHAR, ',' ORDER BY k) AS arcs, min(arc) AS arc FROM tour t JOIN least l USING (nation, root, first) WHERE arc = CASE WHEN first < 0 THEN -first - 1 ELSE first END GROUP BY 1, 2, 3),
corner AS (SELECT t.nation, t.root, loops.first, t.k, b.ax, b.ay FROM loops JOIN tour t USING (nation, root, first) JOIN b ON b.nation = t.nation AND b.root = t.root AND b.arc_ref = t.cur),
turned AS (SELECT nation, root, first, ax, ay, (k - first_value(k) OVER (PARTITION BY nation, root, first ORDER BY ax, ay) + count(*) OVER (PARTITION BY nation, root, first)) % count(*) OVER (PARTITION BY nation, root, first) AS k FROM corner),
outline AS (SELECT nation, root, first, string_agg('[' || ax || ',' || ay || ']', ',' ORDER BY k) || ',' || min('[' || ax || ',' || ay || ']') FILTER (k = 0) AS coords, count(*) + 1 AS n_points,
  abs(sum(ax * nay - nax * ay)) AS area2 FROM (SELECT *, coalesce(lead(ax) OVER v, first_value(ax) OVER v) AS nax, coalesce(lead(ay) OVER v, first_value(ay) OVER v) AS nay FROM turned WINDOW v AS (PARTITION BY nation, root, first ORDER BY k)) GROUP BY 1, 2, 3),
merged AS (SELECT loops.nation AS merge_id, dense_rank() OVER (PARTITION BY loops.nation ORDER BY root) - 1 AS poly_idx, row_number() OVER (PARTITION BY loops.nation, root ORDER BY area2 DESC) - 1 AS ring_idx, arcs, coords, area2 FROM loops JOIN outline USING (nation, root, first))
"""


def _arcs_text(arcs):
    """References as text, from the one of the least arc on."""
    return F.array_join(S.rotated(arcs, F.transform(arcs, S.arc_id)).cast("array<string>"), ",")


def _merged(spark, d):
    g = grid(spark, d)
    return merge.merge(g.selection, g.arc_refs, g.arcs, g.features)


@query(RINGS + "SELECT merge_id, poly_idx::INT AS poly_idx, ring_idx::INT AS ring_idx, ring_idx = 0 AS is_exterior, arcs, coords, area2 FROM merged")
def merge_by_nation(spark, d):
    coords = F.array_join(F.transform(S.least_first(F.col("coords")), lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ",")
    return _merged(spark, d).select("merge_id", "poly_idx", "ring_idx", "is_exterior", _arcs_text(F.col("arcs")).alias("arcs"), coords.alias("coords"), "area2")


def _ring_arcs(rings):
    whole = rings.groupBy("merge_id", "poly_idx", "ring_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "arc_ref"))).alias("a"))
    return whole.select("merge_id", "poly_idx", _arcs_text(F.col("a.arc_ref")).alias("arcs"))


@query(RINGS + "SELECT merge_id, poly_idx::INT AS poly_idx, arcs FROM merged")
def merge_arcs_by_nation(spark, d):
    g = grid(spark, d)
    return _ring_arcs(merge.merge_arcs(g.selection, g.arc_refs, g.arcs))


@query(RINGS + "SELECT merge_id, poly_idx::INT AS poly_idx, arcs FROM merged")
def merge_arcs_boundary_only(spark, d):
    g = grid(spark, d)
    return _ring_arcs(merge.merge_arcs_by_component(g.selection, g.arc_refs, g.arcs, walk=False))


@query(RINGS + """, polygon AS (SELECT merge_id, poly_idx, '[' || string_agg('[' || coords || ']', ',' ORDER BY ring_idx) || ']' AS p FROM merged GROUP BY 1, 2)
SELECT merge_id, '{"type":"MultiPolygon","coordinates":[' || string_agg(p, ',' ORDER BY poly_idx) || ']}' AS geometry FROM polygon GROUP BY 1""")
def merge_geojson(spark, d):
    return merge.geojson(_merged(spark, d), canonical=True)


@query("SELECT min(sx) AS x0, min(sy) AS y0, max(ex) AS x1, max(ey) AS y1 FROM arcs")
def arcs_bbox(spark, d):
    return merge.bbox(grid(spark, d).arcs)


ADJACENT = "SELECT a.geom_id, b.geom_id AS nbr FROM r a JOIN r b ON a.arc_id = b.arc_id AND a.geom_id <> b.geom_id"


@query(f", a AS (SELECT DISTINCT * FROM ({ADJACENT})) SELECT g AS geom_id, coalesce((SELECT string_agg(nbr::VARCHAR, ',' ORDER BY nbr) FROM a WHERE a.geom_id = g), '') AS neighbors FROM cells")
def neighbors_list(spark, d):
    g = grid(spark, d)
    return neighbors.neighbors(g.arc_refs, g.features).select("geom_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f", a AS (SELECT DISTINCT * FROM ({ADJACENT})) SELECT geom_id, nbr FROM a")
def neighbors_all(spark, d):
    return neighbors.edges(grid(spark, d).arc_refs, "all")


@query(f", a AS (SELECT DISTINCT * FROM ({ADJACENT})) SELECT degree, count(*) AS n FROM (SELECT geom_id, count(*) AS degree FROM a GROUP BY geom_id) GROUP BY degree")
def neighbor_degree(spark, d):
    return neighbors.edges(grid(spark, d).arc_refs).groupBy("geom_id").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


#: Cells whose key is a multiple of 3 once more, as geometries of their own in the same layer.
SHARED = """, hi AS (SELECT max(g) + 1 AS m FROM cells),
q AS (SELECT geom_id, arc_id, forward FROM r UNION ALL SELECT geom_id + m, arc_id, forward FROM r, hi WHERE geom_id % 3 = 0)
"""


def _shared(g):
    top = g.features.agg((F.max("geom_id") + 1).alias("m"))
    more = g.arc_refs.where("geom_id % 3 = 0").join(F.broadcast(top)).withColumn("geom_id", F.col("geom_id") + F.col("m")).drop("m")
    return g.arc_refs.unionByName(more)


@query(SHARED + """, s AS (SELECT arc_id, min(geom_id) FILTER (forward) AS fwd, min(geom_id) FILTER (NOT forward) AS rev FROM q GROUP BY 1),
e AS (SELECT DISTINCT geom_id, CASE WHEN geom_id = fwd THEN rev ELSE fwd END AS nbr FROM q JOIN s USING (arc_id)) SELECT geom_id, nbr FROM e WHERE nbr IS NOT NULL AND nbr <> geom_id""")
def neighbors_shared(spark, d):
    return neighbors.edges(_shared(grid(spark, d)))


@query(SHARED + """, s AS (SELECT arc_id, min(geom_id) AS one FROM q GROUP BY 1)
SELECT geom_id, one AS nbr FROM q JOIN s USING (arc_id) WHERE geom_id <> one UNION SELECT one, geom_id FROM q JOIN s USING (arc_id) WHERE geom_id <> one""")
def neighbors_shared_all(spark, d):
    return neighbors.edges(_shared(grid(spark, d)), "all")


COUNTS = ", n AS (SELECT arcs.arc_id, sx, sy, coalesce(sum(forward::INT), 0)::BIGINT AS ref_fwd, coalesce(sum((NOT forward)::INT), 0)::BIGINT AS ref_rev FROM arcs LEFT JOIN r ON r.arc_id = arcs.arc_id GROUP BY 1, 2, 3)\n"


@query(COUNTS + "SELECT arc_id, ref_fwd, ref_rev, ref_fwd + ref_rev AS ref_count, ref_fwd <> ref_rev AS outline FROM n")
def arc_ref_counts(spark, d):
    g = grid(spark, d)
    return order.ref_counts(g.arc_refs, g.arcs)


@query(COUNTS + "SELECT arc_id FROM n WHERE ref_fwd <> ref_rev")
def outline_arcs(spark, d):
    g = grid(spark, d)
    return order.ref_counts(g.arc_refs, g.arcs).where("outline").select("arc_id")


KEYS = COUNTS + """, b AS (SELECT min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1 FROM arcs),
q AS (SELECT n.*, trunc((sx - x0) * (65535.0::DOUBLE / CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END))::BIGINT AS qx, trunc((sy - y0) * (65535.0::DOUBLE / CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END))::BIGINT AS qy FROM n, b),
k AS (WITH RECURSIVE t(arc_id, s, x, y, d) AS (SELECT arc_id, 32768::BIGINT, least(qx, 65535), least(qy, 65535), 0::BIGINT FROM q UNION ALL
  SELECT arc_id, s // 2, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN s - 1 - y ELSE y END ELSE x END, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN s - 1 - x ELSE x END ELSE y END,
    d + s * s * xor(CASE WHEN (x & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM t WHERE s > 0) SELECT arc_id, d AS key FROM t WHERE s = 0)
"""


@query(KEYS + "SELECT arc_id, key FROM k")
def hilbert_key(spark, d):
    g = grid(spark, d)
    return order.keyed(g.arcs, g.arc_refs).select("arc_id", "key")


@query(KEYS + "SELECT arc_id, row_number() OVER (ORDER BY ref_fwd <> ref_rev DESC, ref_fwd + ref_rev DESC, key, arc_id) - 1 AS new_id FROM n JOIN k USING (arc_id)")
def order_hierarchical_hilbert(spark, d):
    g = grid(spark, d)
    return order.hierarchical_hilbert(g.arcs, g.arc_refs)


#: Two layers, first `odd` (cells of an odd x), then all cells; each geometry's key is that of its first arc's first point.
TWO_LAYERS = """, two AS (SELECT 0 AS place, geom_id, pos, arc_id, forward FROM r WHERE x % 2 = 1 UNION ALL SELECT 1, geom_id, pos, arc_id, forward FROM r),
n AS (SELECT arcs.arc_id, coalesce(sum(forward::INT), 0) <> coalesce(sum((NOT forward)::INT), 0) AS outline FROM arcs LEFT JOIN two ON two.arc_id = arcs.arc_id GROUP BY 1),
f AS (SELECT place, geom_id, sx, sy FROM two JOIN arcs USING (arc_id) WHERE pos = 0), fb AS (SELECT min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1 FROM f),
q AS (SELECT place, geom_id, trunc((sx - x0) * (65535.0::DOUBLE / CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END))::BIGINT AS qx, trunc((sy - y0) * (65535.0::DOUBLE / CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END))::BIGINT AS qy FROM f, fb),
k AS (WITH RECURSIVE t(place, geom_id, s, x, y, d) AS (SELECT place, geom_id, 32768::BIGINT, least(qx, 65535), least(qy, 65535), 0::BIGINT FROM q UNION ALL
  SELECT place, geom_id, s // 2, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN s - 1 - y ELSE y END ELSE x END, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN s - 1 - x ELSE x END ELSE y END,
    d + s * s * xor(CASE WHEN (x & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM t WHERE s > 0) SELECT place, geom_id, row_number() OVER (ORDER BY d, place, geom_id) AS walk FROM t WHERE s = 0),
v AS (SELECT arc_id, min(walk * 4 + pos) AS visit FROM two JOIN k USING (place, geom_id) GROUP BY 1)
"""


@query(TWO_LAYERS + "SELECT n.arc_id, row_number() OVER (ORDER BY outline DESC, visit NULLS FIRST, n.arc_id) - 1 AS new_id FROM n LEFT JOIN v ON v.arc_id = n.arc_id")
def order_hilbert(spark, d):
    g = grid(spark, d)
    odd = g.arc_refs.where(f"geom_id % {WIDTH} % 2 = 1").withColumn("layer", F.lit("odd"))
    return order.arc_order(g.arc_refs.unionByName(odd), g.arcs, "hilbert", ["odd", "cell"])


@query(COUNTS + """, s AS (SELECT *, ref_fwd + ref_rev AS c, row_number() OVER (PARTITION BY ref_fwd + ref_rev ORDER BY sx, arc_id) - 1 AS p, count(*) OVER (PARTITION BY ref_fwd + ref_rev) AS m FROM n)
SELECT arc_id, row_number() OVER (ORDER BY ref_fwd <> ref_rev DESC, c DESC, p // ceil(m / ceil(sqrt(m)))::BIGINT, sy, sx, arc_id) - 1 AS new_id FROM s""")
def order_str(spark, d):
    g = grid(spark, d)
    return order.hierarchical_str(g.arcs, g.arc_refs)


@query()
def order_greedy_path(spark, d):
    g = grid(spark, d)
    return order.hierarchical_greedy(g.arcs, g.arc_refs)


#: Orders by customer: sizes that differ.
SIZES = "(SELECT c_custkey::INT AS k, (coalesce(n_orders, 0) * 97 + c_custkey % 13)::BIGINT AS size FROM customer LEFT JOIN " + ORDERS + " ON o_custkey = c_custkey)"


def _sizes(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("int").alias("arc_id")).agg(F.count("*").alias("n"))
    cells = grid(spark, d).features.select(F.col("geom_id").alias("arc_id"))
    return cells.join(n, "arc_id", "left").select("arc_id", (F.coalesce("n", F.lit(0)) * 97 + F.col("arc_id") % 13).alias("byte_len"))


@query(f"SELECT k AS arc_id, size AS byte_len, (sum(size) OVER (ORDER BY k) - size)::BIGINT AS byte_offset FROM {SIZES}", False)
def offsets_unequal(spark, d):
    return prefix_sum(_sizes(spark, d), "arc_id", F.col("byte_len"), "byte_offset")


@query(f"WITH RECURSIVE z AS {SIZES}, t(arc_id, byte_len, block_id, used) AS (SELECT k, size, 0::BIGINT, size FROM z WHERE k = 0 UNION ALL SELECT z.k, z.size, CASE WHEN used > 0 AND used + z.size > 4096 THEN block_id + 1 ELSE block_id END, CASE WHEN used > 0 AND used + z.size > 4096 THEN z.size ELSE used + z.size END FROM t JOIN z ON z.k = t.arc_id + 1) SELECT arc_id, byte_len, block_id, (used - byte_len)::BIGINT AS local_offset FROM t", False)
def blocks_unequal(spark, d):
    return blocks.block_offsets(blocks.assign_blocks(_sizes(spark, d)))


def _blocks(spark, d):
    return blocks.assign_blocks(grid(spark, d).arcs.select("arc_id", (F.size("points") * 16).alias("byte_len")))


@query("SELECT arc_id, 32::BIGINT AS byte_len, (arc_id // 128)::BIGINT AS block_id FROM arcs")
def block_assignment(spark, d):
    return _blocks(spark, d)


@query("SELECT arc_id, (arc_id // 128)::BIGINT AS block_id FROM (SELECT DISTINCT arc_id FROM r)")
def block_lookup(spark, d):
    return blocks.lookup(_blocks(spark, d), grid(spark, d).arc_refs.select("arc_id").distinct())


@query("SELECT arc_id, 32::BIGINT AS byte_len, (arc_id // 128)::BIGINT AS block_id, ((arc_id % 128) * 32)::BIGINT AS local_offset FROM arcs")
def block_local_offsets(spark, d):
    return blocks.block_offsets(_blocks(spark, d))


def stored_grid(spark: SparkSession, sf_dir: str) -> str:
    """The derived topology, written as a quantized container in the shared folder."""
    g = grid(spark, sf_dir)
    features = g.features.select("layer", "geom_id", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("acctbal"), F.struct(F.col("c_nationkey").alias("nation")).alias("at"))).alias("properties"))
    path = f"{shared_dir(spark)}/container-{uuid.uuid4().hex}"
    write_container({"arcs": g.arcs, "arc_refs": g.arc_refs, "features": features}, path, {"scale": [1, 1], "translate": [0, 0]})
    return path


@query("SELECT arc_id, sx, sy, ex, ey FROM arcs")
def container_arcs(spark, d):
    return read_container(spark, stored_grid(spark, d)).select("arc_id", "sx", "sy", "ex", "ey")


@query("SELECT 'cell' AS layer, geom_id, 0 AS poly_idx, 0 AS ring_idx, pos::INT AS pos, arc_ref::INT AS arc_ref, arc_id::INT AS arc_id, forward FROM r")
def container_arc_refs(spark, d):
    return read_container(spark, stored_grid(spark, d), "arc_refs", layer="cell")


@query('SELECT g AS geom_id, c_name AS name, c_acctbal::DOUBLE AS acctbal, nation::SMALLINT AS "at/nation" FROM cells')
def container_columns(spark, d):
    return read_container(spark, stored_grid(spark, d), "features", layer="cell")


@query("SELECT arc_id, sx, sy, ex, ey FROM arcs WHERE arc_id IN (SELECT arc_id FROM r WHERE geom_id % 25 = 0)")
def container_arcs_by_id(spark, d):
    """The arcs of the first column of cells, by ids that the references give."""
    ids = grid(spark, d).arc_refs.where("geom_id % 25 = 0").select("arc_id").distinct()
    found = ",".join(str(r.arc_id) for r in ids.orderBy("arc_id").collect())
    return read_container(spark, stored_grid(spark, d), ids=found).select("arc_id", "sx", "sy", "ex", "ey")


@query("SELECT arc_id, sx, sy, ex, ey FROM arcs")
def container_endpoints(spark, d):
    return read_container(spark, stored_grid(spark, d), "endpoints")


@query("SELECT arc_id, sx, ey FROM arcs WHERE arc_id >= 100 AND arc_id < 2000")
def container_pruned_scan(spark, d):
    """A plain filter on arc ids, pushed into the source where the session allows it."""
    return read_container(spark, stored_grid(spark, d)).where("arc_id >= 100 AND arc_id < 2000").select("arc_id", "sx", "ey")


@query("SELECT geom_id, pos, arc_ref FROM r")
def container_roundtrip(spark, d):
    """Written, decoded to tables, written and read again."""
    again = f"{shared_dir(spark)}/container-{uuid.uuid4().hex}"
    write_container(decode_container(spark, stored_grid(spark, d)), again, {"scale": [1, 1], "translate": [0, 0]})
    return read_container(spark, again, "arc_refs").select("geom_id", "pos", "arc_ref")


@query("SELECT g AS geom_id, c_name AS name, (g % 7)::DOUBLE AS acctbal FROM cells")
def rewrite_property(spark, d):
    again = f"{shared_dir(spark)}/container-{uuid.uuid4().hex}"
    n = table(spark, d, "customer").count()
    rewrite_container(stored_grid(spark, d), again, {"cell/acctbal": [float(k % 7) + 0.0 for k in range(n)]})
    return read_container(spark, again, "features", layer="cell").select("geom_id", "name", F.col("acctbal").cast("double").alias("acctbal"))


@query("SELECT geom_id, pos, arc_ref FROM r")
def topojson_roundtrip(spark, d):
    """The topology as one JSON document in a file and back, through the container's tables."""
    path = f"{shared_dir(spark)}/topology-{uuid.uuid4().hex}"
    save_topology(decode_container(spark, stored_grid(spark, d)), path)
    return load_topology(spark, path)["arc_refs"].select("geom_id", "pos", "arc_ref")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
