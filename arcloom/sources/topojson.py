"""Nested topology JSON to tables and back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, located, shared_dir, stored

REFS = "layer string, geom_id int, poly_idx int, ring_idx int, pos int, arc_ref int, arc_id int, forward boolean"
ARCS = "arc_id int, points array<struct<x:double,y:double>>, sx double, sy double, ex double, ey double"
FEATURES = "layer string, geom_id int, geom_type string, properties string"
#: Bytes of a document that are read at once, and those of one task's pieces.
READ, PIECE = 4 << 20, 1 << 20


def arc_row(k: int, arc: list, quantized: bool) -> tuple:
    x = y = 0.0
    points = []
    for p in arc:
        x, y = (x + p[0], y + p[1]) if quantized else (p[0], p[1])
        points.append((float(x), float(y)))
    return (k, points, *points[0], *points[-1]) if points else (k, [], None, None, None, None)


def ref_rows(layer: str, g: int, geometry: dict) -> Iterator[tuple]:
    kind = geometry.get("type")
    polygons = [geometry["arcs"]] if kind == "Polygon" else geometry["arcs"] if kind == "MultiPolygon" else []
    for p, polygon in enumerate(polygons):
        for r, ring in enumerate(polygon):
            for n, ref in enumerate(ring):
                yield layer, g, p, r, n, ref, ref if ref >= 0 else ~ref, ref >= 0


def feature_row(layer: str, g: int, geometry: dict) -> tuple:
    return layer, g, str(geometry.get("type")), json.dumps(geometry.get("properties") or {})


def check_layer(layer: str, kind) -> None:
    if kind != "GeometryCollection":
        raise ValueError(f"layer {layer} is no GeometryCollection")
    if "/" in layer:
        raise ValueError(f"layer name {layer} holds a slash")


def read_topology(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """arcs, arc_refs, features (properties as JSON text) of one topology, a JSON document on the driver.

    Quantized arcs (a transform is present) are given as running sums. Only the first two
    coordinates of a point count. Geometries other than polygons keep their place without
    references; a layer that is no collection raises. `load_topology` reads a large document.
    """
    topology = json.loads(text)
    quantized = topology.get("transform") is not None
    refs, features = [], []
    for layer, obj in topology["objects"].items():
        check_layer(layer, obj.get("type"))
        for g, geometry in enumerate(obj["geometries"]):
            refs += ref_rows(layer, g, geometry)
            features.append(feature_row(layer, g, geometry))
    return {
        "arcs": spark.createDataFrame([arc_row(k, arc, quantized) for k, arc in enumerate(topology["arcs"])], ARCS),
        "arc_refs": spark.createDataFrame(refs, REFS),
        "features": spark.createDataFrame(features, FEATURES),
    }


class Scan:
    """Values of a JSON document one after another, by their place in it; holds one value and READ bytes.

    Bytes are looked at as Latin-1, so that a character is a byte; names are decoded where they are given.
    """

    def __init__(self, file):
        self.file, self.text, self.base, self.at, self.decoder = file, "", 0, 0, json.JSONDecoder()

    def fill(self) -> bool:
        data = self.file.read(max(READ, len(self.text) - self.at))
        self.text, self.base, self.at = self.text[self.at :] + bytes(data).decode("latin-1"), self.base + self.at, 0
        return bool(data)

    def peek(self) -> str:
        while True:
            while self.at < len(self.text):
                if (c := self.text[self.at]) not in " \t\r\n":
                    return c
                self.at += 1
            if not self.fill():
                raise ValueError("the document ends too early")

    def take(self, c: str) -> None:
        if (found := self.peek()) != c:
            raise ValueError(f"{found!r} instead of {c!r} at byte {self.base + self.at}")
        self.at += 1

    def value(self, raw: bool = False):
        """The next value; `raw`: its text."""
        self.peek()
        while True:
            try:
                out, end = self.decoder.raw_decode(self.text, self.at)
                size = end - self.at
                if end < len(self.text) or not self.fill():
                    self.at += size
                    return self.text[self.at - size : self.at] if raw else out
            except json.JSONDecodeError:
                if not self.fill():
                    raise

    def entries(self, end: str) -> Iterator[None]:
        """Stops at each entry of an object or a list, which the caller takes."""
        if self.peek() != end:
            yield
            while self.peek() == ",":
                self.at += 1
                yield
        self.take(end)

    def keys(self) -> Iterator[str]:
        self.take("{")
        seen = set()
        for _ in self.entries("}"):
            key = json.loads(self.value(raw=True).encode("latin-1"))
            if key in seen:
                raise ValueError(f"{key!r} is given twice")
            seen.add(key)
            self.take(":")
            yield key

    def pieces(self) -> Iterator[tuple[int, int, int]]:
        """(number of its first value, offset, length) of pieces of a list."""
        self.take("[")
        first, n, offset, last = 0, 0, None, 0
        for _ in self.entries("]"):
            self.peek()
            start = self.base + self.at
            if offset is not None and start - offset > PIECE:
                yield first, offset, last - offset
                first, offset = n, None
            offset = start if offset is None else offset
            self.value()
            n, last = n + 1, self.base + self.at
        if offset is not None:
            yield first, offset, last - offset


PIECES = "kind string, layer string, first long, offset long, length long"


def scanned(path: str) -> Iterator[tuple]:
    """The pieces of a topology's arcs and geometries; a row for a transform, if there is one."""
    fs, where = located(path)
    with fs.open_input_stream(where) as f:
        scan, got = Scan(f), set()
        for key in scan.keys():
            got.add(key)
            if key == "arcs":
                yield from (("arc", None, *piece) for piece in scan.pieces())
            elif key == "objects":
                for layer in scan.keys():
                    kind = None
                    for k in scan.keys():
                        if k == "geometries":
                            yield from (("geometry", layer, *piece) for piece in scan.pieces())
                        else:
                            kind = scan.value() if k == "type" else (scan.value(), kind)[1]
                    check_layer(layer, kind)
            elif scan.value() is not None and key == "transform":
                yield "transform", None, 0, 0, 0
        if missing := {"arcs", "objects"} - got:
            raise ValueError(f"{path} has no {sorted(missing)}")


def load_topology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What `read_topology` gives, of a JSON document in a file that all executors see.

    One task looks for the places of arcs and geometries, with a few MB at a time; the tables
    are read from those by many. A name given twice in an object raises.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for row in scanned(p):
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k < 2 else pa.int64()) for k, v in enumerate(row)], names)

    found = stored(spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(find, PIECES))
    quantized = bool(found.where("kind = 'transform'").limit(1).count())
    tasks = max(1, min(found.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def table(kind: str, schema: str, rows_of) -> DataFrame:
        to = pa.schema([(f.name, KINDS[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, where = located(path)
            with fs.open_input_file(where) as f:
                for batch in batches:
                    for piece in batch.to_pylist():
                        values = json.loads(b"[" + f.read_at(piece["length"], piece["offset"]) + b"]")
                        rows = [row for k, v in enumerate(values, piece["first"]) for row in rows_of(piece["layer"], k, v)]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

        return found.where(F.col("kind") == kind).repartition(tasks).mapInArrow(read, schema)

    return {
        "arcs": table("arc", ARCS, lambda _, k, v: [arc_row(k, v, quantized)]),
        "arc_refs": table("geometry", REFS, ref_rows),
        "features": table("geometry", FEATURES, lambda layer, k, v: [feature_row(layer, k, v)]),
    }


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<struct<x:double,y:double>>": pa.list_(POINT)}


def geometries(arc_refs: DataFrame, features: DataFrame) -> DataFrame:
    """(layer, geom_id, geom_type, arcs): nested references polygon > ring > reference, [] where there are none."""
    rings = arc_refs.groupBy("layer", "geom_id", "poly_idx", "ring_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "arc_ref"))).alias("r"))
    polygons = rings.groupBy("layer", "geom_id", "poly_idx").agg(F.array_sort(F.collect_list(F.struct("ring_idx", F.col("r.arc_ref").alias("ring")))).alias("p"))
    whole = polygons.groupBy("layer", "geom_id").agg(F.array_sort(F.collect_list(F.struct("poly_idx", F.col("p.ring").alias("polygon")))).alias("g"))
    return features.select("layer", "geom_id", "geom_type").join(whole, ["layer", "geom_id"], "left").select("layer", "geom_id", "geom_type", F.coalesce(F.col("g.polygon"), F.array().cast("array<array<array<int>>>")).alias("arcs"))


def write_topology(tables: dict[str, DataFrame]) -> str:
    """One JSON document, on the driver; `save_topology` writes a large one to a file."""
    objects: dict = {}
    rows = geometries(tables["arc_refs"], tables["features"]).join(tables["features"].select("layer", "geom_id", "properties"), ["layer", "geom_id"]).orderBy("layer", "geom_id")
    for r in rows.toLocalIterator():
        arcs = r.arcs[0] if r.geom_type == "Polygon" and r.arcs else r.arcs
        objects.setdefault(r.layer, {"type": "GeometryCollection", "geometries": []})["geometries"].append({"type": r.geom_type, "arcs": arcs, "properties": json.loads(r.properties or "{}")})
    arcs = [[[p.x, p.y] for p in r.points] for r in tables["arcs"].orderBy("arc_id").toLocalIterator()]
    return json.dumps({"type": "Topology", "arcs": arcs, "objects": objects})


def save_topology(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON document in a file: a line for each geometry and arc, made in tasks.

    The driver copies the tasks' text into the file, some MB at a time, as the file is one.
    """
    spark = tables["arcs"].sparkSession
    kind = F.to_json(F.array(F.coalesce("geom_type", F.lit("None"))))
    arcs = F.when((F.col("geom_type") == "Polygon") & (F.size("arcs") > 0), F.to_json(F.col("arcs")[0])).otherwise(F.to_json("arcs"))
    properties = F.coalesce(F.nullif("properties", F.lit("")), F.lit("{}"))
    rows = geometries(tables["arc_refs"], tables["features"]).join(tables["features"].select("layer", "geom_id", "properties"), ["layer", "geom_id"])
    rows = stored(rows.select("layer", "geom_id", F.concat(F.lit('{"type": '), F.regexp_extract(kind, r"^\[(.*)\]$", 1), F.lit(', "arcs": '), arcs, F.lit(', "properties": '), properties, F.lit("}")).alias("line")))
    lines = stored(tables["arcs"].select("arc_id", F.to_json(F.transform("points", lambda p: F.array(p["x"], p["y"]))).alias("line")))
    fs, where = located(path)

    def copy(out, df: DataFrame) -> None:
        folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        df.select("line").write.text(folder, lineSep=",\n")
        at, inside = located(folder)
        held = b""  # the last two bytes, which a list's last line doesn't need
        for info in sorted(at.get_file_info(pyarrow.fs.FileSelector(inside)), key=lambda x: x.base_name):
            if not info.base_name.startswith("part-"):
                continue
            with at.open_input_stream(info.path) as f:
                while data := f.read(READ):
                    data = held + data
                    out.write(data[:-2])
                    held = data[-2:]
        at.delete_dir(inside)

    with fs.open_output_stream(where) as out:
        out.write(b'{"type": "Topology", "arcs": [\n')
        copy(out, lines.orderBy("arc_id"))
        out.write(b'\n], "objects": {')
        for k, r in enumerate(rows.select("layer").distinct().orderBy("layer").collect()):
            out.write(f'{", " if k else ""}{json.dumps(r.layer)}: {{"type": "GeometryCollection", "geometries": [\n'.encode())
            copy(out, rows.where(F.col("layer") == r.layer).orderBy("geom_id"))
            out.write(b"\n]}")
        out.write(b"}}\n")
    discard(rows, lines)
