"""The binary container of a topology: sections, block-compressed arcs, typed property columns.

Reading is a Spark data source, `format("arc_container")`, that reads only the byte ranges
its table needs; a task takes a group of arc blocks or a layer. Arcs are encoded and compressed
in tasks; as a container is one file whose footer names every section, the driver puts it together.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.blocks import TARGET, assign_blocks
from ..operators.props import nest
from ..storage import discard, located, stored
from .topojson import ARCS, REFS

#: Fixed values of the format: magic, version 2.0.0, sizes, element types, codec names.
MAGIC, VERSION, MAJORS = b"CTPO", 2 << 24, (1, 2)
HEADER, ALIGN, NAME = 16, 16, 16
DTYPES = {"i8": "<i1", "u8": "<u1", "i16": "<i2", "u16": "<u2", "i32": "<i4", "u32": "<u4", "f64": "<f8"}
CODECS = {"zst": "zstd", "br": "brotli"}
STRUCTURE = ("poly_offsets", "ring_offsets", "arc_refs", "arc_refs_blocks", "arc_refs_partitions", "multi_poly_breaks")
SPARK_TYPES = {"i8": "tinyint", "u8": "smallint", "i16": "smallint", "u16": "int", "i32": "int", "u32": "bigint", "f64": "double", "strings": "string"}
ENDPOINTS = "arc_id int, sx double, sy double, ex double, ey double"
#: Compressed bytes of arc blocks that a task reads.
SPLIT = 8 << 20


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Zigzag LEB128 of 32-bit integers, and how many bytes each takes."""
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < -(2**31) or v.max() >= 2**31):
        raise ValueError("a coordinate is beyond 32 bits")
    z = (v << 1) ^ (v >> 63)
    size = 1 + (z[:, None] >= 1 << (7 * np.arange(1, 5))).sum(axis=1)
    lane = np.arange(5)
    out = (z[:, None] >> (7 * lane)) & 127 | np.where(lane < size[:, None] - 1, 128, 0)
    return out[lane < size[:, None]].astype(np.uint8).tobytes(), size


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(b):
        return b
    if b[-1] > 127:
        raise ValueError("a varint ends too early")
    start = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    if place.max() > 4 or (b[place == 4] > 15).any():
        raise ValueError("a varint is beyond 32 bits")
    z = np.add.reduceat((b & 127) << (7 * place), start)
    return (z >> 1) ^ -(z & 1)


def deltas(values: np.ndarray) -> bytes:
    return np.diff(np.asarray(values, np.uint32), prepend=np.uint32(0)).astype("<u4").tobytes()


def pack_strings(values: list) -> bytes:
    each = [("" if v is None else str(v)).encode() for v in values]
    ends = np.cumsum([0, *map(len, each)])
    return struct.pack("<II", len(each), 0) + ends.astype("<u4").tobytes() + b"".join(each)


def unpack_strings(data: bytes) -> list[str]:
    n = struct.unpack_from("<I", data)[0]
    at = np.frombuffer(data, "<u4", n + 1, 8)
    text = data[8 + 4 * (n + 1) :]
    return [text[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def pack_column(values: list) -> tuple[str, bytes]:
    """(type, bytes) of a property column; a missing value is 0 or an empty string, as the format has no nulls."""
    known = [v for v in values if v is not None]
    if not known or all(isinstance(v, str) for v in known):
        return "strings", pack_strings(values)
    if not all(isinstance(v, bool | int | float) for v in known):
        raise ValueError("a property mixes numbers and strings, or holds other values")
    if all(float(v).is_integer() for v in known):
        low, high = min(known), max(known)
        for kind in ("u8", "u16", "u32") if low >= 0 else ("i8", "i16", "i32"):
            limits = np.iinfo(DTYPES[kind])
            if limits.min <= low and high <= limits.max:
                return kind, np.array([int(v or 0) for v in values], DTYPES[kind]).tobytes()
        raise ValueError("an integer property is beyond 32 bits")
    return "f64", np.array([0.0 if v is None else v for v in values], "<f8").tobytes()


class Container:
    """A container's footer, and its sections by positional reads; a compressed region is opened once."""

    def __init__(self, path: str):
        fs, where = located(path)
        self.file, self.regions = fs.open_input_file(where), {}
        size = self.file.size()
        if size < HEADER + 8:
            raise ValueError(f"{path} is too small for a container")
        head = self.at(0, HEADER)
        if head[:4] != MAGIC or head[7] not in MAJORS:
            raise ValueError(f"{path} has another magic or version")
        n = struct.unpack("<Q", self.at(size - 8, 8))[0]
        if n > size - 8 - HEADER:
            raise ValueError(f"{path}: the footer doesn't fit the file")
        footer = self.at(size - 8 - n, n)
        count, length = struct.unpack_from("<II", footer)
        row = NAME + 16
        self.meta = json.loads(footer[8 + count * row : 8 + count * row + length])
        if len(self.meta["sections"]) != count:
            raise ValueError(f"{path}: the section count differs")
        if not isinstance(self.meta.get("arcCoordsBlocks"), dict):
            raise ValueError(f"{path}: no arcCoordsBlocks")
        places = [struct.unpack_from("<QQ", footer, 8 + k * row + NAME) for k in range(count)]
        self.sections = {s["name"]: s | {"offset": a, "length": b} for s, (a, b) in zip(self.meta["sections"], places, strict=True)}
        self.layers = {x["name"]: x for x in self.meta["layers"]}
        self.size = size
        self.check()

    def at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def bytes_of(self, name: str) -> bytes:
        if name not in self.sections:
            raise ValueError(f"no section {name}")
        s = self.sections[name]
        if (codec := s.get("compression")) is None:
            return self.at(s["offset"], s["length"])
        if s["offset"] not in self.regions:
            self.regions[s["offset"]] = pa.decompress(self.at(s["offset"], s["length"]), s["uncompressedRegionLength"], CODECS[codec], asbytes=True)
        region = self.regions[s["offset"]]
        return region if s.get("groupOffset") is None else region[s["groupOffset"] : s["groupOffset"] + s["groupLength"]]

    def numbers(self, name: str) -> np.ndarray:
        s = self.sections.get(name, {})
        out = np.frombuffer(self.bytes_of(name), DTYPES[s["type"]])
        return np.cumsum(out, dtype=np.uint32) if s.get("delta") else out

    def column(self, name: str) -> list:
        return unpack_strings(self.bytes_of(name)) if self.sections.get(name, {}).get("type") == "strings" else self.numbers(name).tolist()

    def properties(self, layer: str) -> list[str]:
        inside = [n[len(layer) + 1 :] for n in self.sections if n.startswith(layer + "/")]
        return [n for n in inside if n not in STRUCTURE]

    def frame(self, data: bytes, dictionary: str | None = None) -> bytes:
        extra = zstandard.ZstdCompressionDict(self.bytes_of(dictionary)) if dictionary else None
        return zstandard.ZstdDecompressor(dict_data=extra).decompressobj().decompress(data)

    def framed(self, section: str, offset: int, length: int, dictionary: str | None = None) -> bytes:
        """A frame of a section that is stored as it is."""
        return self.frame(self.at(self.sections[section]["offset"] + int(offset), int(length)), dictionary)

    def arc_offsets(self) -> np.ndarray:
        blocks = self.meta.get("arcOffsetsBlocks")
        if blocks is None:
            return self.numbers("arc_offsets").astype(np.int64)
        out, base = [], 0
        for _, offset, length in self.numbers(blocks["blockTableSection"]).reshape(-1, 3):
            part = np.cumsum(np.frombuffer(self.framed(blocks["partitionsSection"], offset, length, blocks.get("dictSection")), "<u4"), dtype=np.uint32).astype(np.int64) + base
            out.append(part[:-1])
            base = int(part[-1])
        return np.concatenate([*out, [base]])

    def has_endpoints(self) -> bool:
        return self.meta.get("arcEndpointsBlocks") is not None

    def endpoints(self, first: int, last: int) -> np.ndarray:
        """Rows (sx, sy, ex, ey) of the arcs of endpoint blocks first..last - 1: four channels of deltas that restart in each block."""
        spec = self.meta["arcEndpointsBlocks"]
        parts = [np.cumsum(from_varints(self.framed(spec["partitionsSection"], o, n, spec.get("dictSection"))).reshape(-1, 4), axis=0) for _, o, n in self.endpoint_blocks()[first:last]]
        return np.concatenate([*parts, np.empty((0, 4), np.int64)])

    def endpoint_blocks(self) -> np.ndarray:
        """Rows (first arc id, offset, length) of the endpoint blocks."""
        return self.numbers(self.meta["arcEndpointsBlocks"]["blockTableSection"]).astype(np.int64).reshape(-1, 3)

    def check(self) -> None:
        """Raises where a described section is missing or lies outside the file, which is found at open and not in a task."""
        for name, s in self.sections.items():
            if s["offset"] + s["length"] > self.size or s["offset"] < HEADER:
                raise ValueError(f"section {name} lies outside the file")
            if s["type"] not in (*DTYPES, "strings", "blob"):
                raise ValueError(f"section {name} has an unknown type {s['type']}")
            if s.get("compression") not in (None, *CODECS):
                raise ValueError(f"section {name} has an unknown compression {s['compression']}")
        need = ["arc_coords", self.meta["arcCoordsBlocks"]["blockTableSection"]]
        for block in [self.meta.get(k) for k in ("arcOffsetsBlocks", "arcEndpointsBlocks")] + [x.get("arcRefsBlocks") for x in self.meta["layers"]]:
            need += [block["blockTableSection"], block["partitionsSection"]] if block else []
        for spec in (self.meta["arcCoordsBlocks"], self.meta.get("arcOffsetsBlocks"), self.meta.get("arcEndpointsBlocks")):
            need += [spec["dictSection"]] if spec and spec.get("dictSection") else []
        need += [] if self.meta.get("arcOffsetsBlocks") else ["arc_offsets"]
        for x in self.meta["layers"]:
            need += [f"{x['name']}/poly_offsets", f"{x['name']}/ring_offsets"] + ([] if x.get("arcRefsBlocks") else [f"{x['name']}/arc_refs"])
        if missing := [n for n in need if n not in self.sections]:
            raise ValueError(f"sections {missing} are described but missing")

    def arc_blocks(self) -> np.ndarray:
        """Rows (end in raw bytes, offset, length) of the arc blocks."""
        return self.numbers(self.meta["arcCoordsBlocks"]["blockTableSection"]).astype(np.int64).reshape(-1, 3)

    def arc_refs(self, layer: str) -> np.ndarray:
        blocks = self.layers[layer].get("arcRefsBlocks")
        if blocks is None:
            return self.numbers(f"{layer}/arc_refs")
        table = self.numbers(blocks["blockTableSection"]).reshape(-1, 4)
        return np.frombuffer(b"".join(self.framed(blocks["partitionsSection"], o, n) for _, o, n, _ in table), "<i4")


def arc_batch(c: Container, part: Part, wanted) -> pa.RecordBatch:
    """The arcs of a group of blocks; the part brings their first id and offsets, so a task reads nothing of other blocks."""
    spec = c.meta["arcCoordsBlocks"]
    raw = b"".join(c.framed("arc_coords", o, n, spec.get("dictSection")) for o, n in part.frames)
    offsets = np.asarray(part.offsets, np.int64)
    inside = np.flatnonzero(wanted(np.arange(part.first, part.first + len(offsets) - 1)))
    points = []
    for a in inside:
        data = raw[offsets[a] - offsets[0] : offsets[a + 1] - offsets[0]]
        points.append(np.frombuffer(data, "<f8").reshape(-1, 2) if c.meta["bytesPerPoint"] == 16 else np.cumsum(from_varints(data).reshape(-1, 2), axis=0).astype(float))
    flat = np.concatenate([*points, np.empty((0, 2))])
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, points)]), pa.int32()), pairs)
    ends = [pa.array([float(p[k, d]) if len(p) else None for p in points], pa.float64()) for k in (0, -1) for d in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(part.first + inside, pa.int32()), lists, *ends], ["arc_id", "points", "sx", "sy", "ex", "ey"])


def endpoint_batch(c: Container, part: Part, wanted) -> pa.RecordBatch:
    rows = c.endpoints(part.first, part.last)
    ids = part.offsets[0] + np.arange(len(rows))
    keep = wanted(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int32()), *(pa.array(rows[keep, k].astype(float)) for k in range(4))], ["arc_id", "sx", "sy", "ex", "ey"])


def ref_batches(c: Container, layer: str, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The references of a layer."""
    n = c.layers[layer]["numGeometries"]
    rings_of, refs_of = c.numbers(f"{layer}/poly_offsets").astype(np.int64)[: n + 1], c.numbers(f"{layer}/ring_offsets").astype(np.int64)
    ring = np.arange(rings_of[0], rings_of[-1])
    geometry = np.repeat(np.arange(n), np.diff(rings_of))
    first = ring == rings_of[geometry]
    breaks = c.numbers(f"{layer}/multi_poly_breaks")[1::2] if f"{layer}/multi_poly_breaks" in c.sections else []
    new = np.isin(ring, breaks) & ~first
    poly = np.cumsum(new)
    poly -= poly[rings_of[geometry] - rings_of[0]]
    within = ring - np.maximum.accumulate(np.where(new | first, ring, 0)) if len(ring) else ring
    size = np.diff(refs_of)[ring]
    refs = c.arc_refs(layer)[refs_of[rings_of[0]] : refs_of[rings_of[-1]]].astype(np.int32)
    pos = np.arange(len(refs)) - np.repeat(refs_of[ring] - refs_of[rings_of[0]], size)
    numbers = [np.repeat(geometry, size), np.repeat(poly, size), np.repeat(within, size), pos, refs, np.where(refs < 0, ~refs, refs)]
    for at in range(0, len(refs), rows):
        part = [pa.array(x[at : at + rows].astype(np.int32)) for x in numbers]
        yield pa.RecordBatch.from_arrays([pa.array([layer] * len(part[0]), pa.string()), *part, pa.array(refs[at : at + rows] >= 0)], [x.split()[0] for x in REFS.split(", ")])


class Part(InputPartition):
    """A layer; or arcs from id `first` on with their offsets and the frames (offset, length) of their blocks; or endpoint blocks."""

    def __init__(self, layer: str = "", first: int = 0, last: int = 0, offsets: tuple = (), frames: tuple = ()):
        self.layer, self.first, self.last, self.offsets, self.frames = layer, first, last, offsets, frames


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.layer = options["path"], options.get("table", "arcs"), options.get("layer")
        self.ids = sorted({int(x) for x in options["ids"].split(",") if x}) if "ids" in options else None
        self.columns = [x for x in options["columns"].split(",") if x] if "columns" in options else None
        self.low, self.high = 0, 2**31

    def narrow(self, filters: list) -> None:
        """Takes comparisons of arc_id with numbers into account; what can't be used is passed over."""
        for f in filters:
            if getattr(f, "attribute", None) != ("arc_id",) or self.table not in ("arcs", "endpoints"):
                continue
            kind = type(f).__name__
            if kind == "In":
                mine = sorted({int(x) for x in f.value if x is not None})
                self.ids = mine if self.ids is None else sorted(set(mine) & set(self.ids))
            elif kind == "EqualTo":
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif kind in ("GreaterThan", "GreaterThanOrEqual"):
                self.low = max(self.low, f.value + (kind == "GreaterThan"))
            elif kind in ("LessThan", "LessThanOrEqual"):
                self.high = min(self.high, f.value - (kind == "LessThan"))

    def wanted(self, ids: np.ndarray) -> np.ndarray:
        keep = (ids >= self.low) & (ids <= self.high)
        return keep if self.ids is None else keep & np.isin(ids, self.ids)

    def holds(self, first: int, end: int) -> bool:
        """Whether any id of first..end - 1 is wanted."""
        a, b = max(first, self.low), min(end - 1, self.high)
        if a > b:
            return False
        return self.ids is None or int(np.searchsorted(self.ids, a)) < int(np.searchsorted(self.ids, b, side="right"))

    def partitions(self) -> list[Part]:
        c = Container(self.path)
        if self.table == "endpoints" and c.has_endpoints():
            table = c.endpoint_blocks()
            firsts = [*table[:, 0].tolist(), c.meta["numArcs"]]
            return [Part("", k, k + 1, (firsts[k],)) for k in range(len(table)) if self.holds(firsts[k], firsts[k + 1])] or [Part(last=-1)]
        if self.table not in ("arcs", "endpoints"):
            return [Part(x) for x in c.layers if self.layer in (None, x)]
        blocks, offsets = c.arc_blocks(), c.arc_offsets()
        # the first arc of each block; an arc without points lies where the next one does
        firsts = np.append(np.searchsorted(offsets[:-1], np.concatenate(([0], blocks[:-1, 0])) if len(blocks) else []), len(offsets) - 1).astype(int).tolist()
        parts, size, run = [], 0, []
        for k in [k for k in range(len(blocks)) if self.holds(firsts[k], firsts[k + 1])] + [None]:
            if run and (k is None or k != run[-1] + 1 or size > SPLIT):
                a, b = firsts[run[0]], firsts[run[-1] + 1]
                parts.append(Part("", a, b, tuple(offsets[a : b + 1].tolist()), tuple((int(o), int(n)) for _, o, n in blocks[run[0] : run[-1] + 1])))
                run, size = [], 0
            if k is not None:
                run.append(k)
                size += int(blocks[k, 2])
        return parts or [Part(last=-1)]

    def read(self, part: Part) -> Iterator:
        if part.last < 0:
            return
        c = Container(self.path)
        if self.table == "arcs":
            yield arc_batch(c, part, self.wanted)
        elif self.table == "endpoints":
            yield endpoint_batch(c, part, self.wanted) if c.has_endpoints() else arc_batch(c, part, self.wanted).select(["arc_id", "sx", "sy", "ex", "ey"])
        elif self.table == "arc_refs":
            yield from ref_batches(c, part.layer)
        else:
            names = c.properties(part.layer) if self.columns is None else self.columns
            yield from zip(range(c.layers[part.layer]["numGeometries"]), *[c.column(f"{part.layer}/{n}") for n in names], strict=True)


class PushingReader(ContainerReader):
    """With filters on arc_id: Spark asks only a session that pushes filters into Python sources."""

    def pushFilters(self, filters: list):  # noqa: N802
        self.narrow(filters)
        return filters  # Spark looks again, as blocks hold other arcs too


class ContainerSource(DataSource):
    """Options: table (arcs, endpoints, arc_refs or features), layer (needed for features), ids (arcs, endpoints), columns (features).

    Only blocks that hold the asked ids, and only the asked columns' sections, are read; where
    the session has spark.sql.python.filterPushdown.enabled, filters on arc_id choose blocks too.
    Endpoints come from their section if the file has one, else from the coordinates.
    """

    @classmethod
    def name(cls) -> str:
        return "arc_container"

    def schema(self) -> str:
        table = self.options.get("table", "arcs")
        if table in ("arcs", "arc_refs", "endpoints"):
            return {"arcs": ARCS, "arc_refs": REFS, "endpoints": ENDPOINTS}[table]
        c, layer = Container(self.options["path"]), self.options.get("layer")
        if table != "features" or layer not in c.layers:
            raise ValueError(f"no table {table} of layer {layer}")
        names = [x for x in self.options["columns"].split(",") if x] if "columns" in self.options else c.properties(layer)
        if missing := [n for n in names if f"{layer}/{n}" not in c.sections]:
            raise ValueError(f"no columns {missing}")
        return ", ".join(["geom_id int", *(f"`{n}` {SPARK_TYPES[c.sections[f'{layer}/{n}']['type']]}" for n in names)])

    def reader(self, schema) -> ContainerReader:
        return (PushingReader if self.options.get("push") == "true" else ContainerReader)(dict(self.options))


def read_container(spark: SparkSession, path: str, table: str = "arcs", **options: str) -> DataFrame:
    spark.dataSource.register(ContainerSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("arc_container").options(table=table, push=pushes, **options).load(path)


def decode_container(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """arcs, arc_refs and features of all layers, as read_topology gives them, so that they can be written again.

    The format keeps no geometry types: one polygon or none is a Polygon, more a MultiPolygon.
    Properties are JSON text, nested again by their paths.
    """
    c = Container(path)
    refs = read_container(spark, path, "arc_refs")
    polygons = refs.groupBy("layer", "geom_id").agg(F.max("poly_idx").alias("last"))
    kind = F.when(F.coalesce("last", F.lit(0)) > 0, "MultiPolygon").otherwise("Polygon")
    features = None
    for layer in c.layers:
        names = c.properties(layer)
        rows = read_container(spark, path, "features", layer=layer)
        nested = nest(rows, names).withColumn("properties", F.to_json("properties", {"ignoreNullFields": "false"})) if names else rows.withColumn("properties", F.lit("{}"))
        one = nested.select(F.lit(layer).alias("layer"), "geom_id", "properties")
        features = one if features is None else features.unionByName(one)
    if features is None:
        features = spark.createDataFrame([], "layer string, geom_id int, properties string")
    features = features.join(polygons, ["layer", "geom_id"], "left").select("layer", "geom_id", kind.alias("geom_type"), "properties")
    return {"arcs": read_container(spark, path), "arc_refs": refs, "features": features}


def assemble(path: str, meta: dict, sections: list[tuple[str, str, bytes, bool]], stored: frozenset[str]) -> None:
    """Writes sections (name, type, bytes, delta); those of `stored`, and what zstd doesn't shorten, stay as they are."""
    out, rows, entries = bytearray(struct.pack("<4sIQ", MAGIC, VERSION, 0)), [], []
    for name, kind, data, delta in sections:
        entry = {"name": name, "type": kind} | ({"delta": True} if delta else {})
        small = data if name in stored else zstandard.ZstdCompressor(level=19).compress(data)
        if len(small) < len(data):
            entry |= {"compression": "zst", "uncompressedRegionLength": len(data)}
        else:
            small = data
        rows.append(name.encode()[:NAME].ljust(NAME, b"\0") + struct.pack("<QQ", len(out), len(small)))
        entries.append(entry)
        out += small + bytes(-len(small) % ALIGN)
    text = json.dumps(meta | {"sections": entries}, separators=(",", ":")).encode()
    footer = struct.pack("<II", len(rows), len(text)) + b"".join(rows) + text
    fs, where = located(path)
    with fs.open_output_stream(where) as f:
        f.write(bytes(out) + footer + struct.pack("<Q", len(footer)))


def encode_batches(batches: Iterator[pa.RecordBatch], quantized: bool) -> Iterator[pa.RecordBatch]:
    """arcs to (arc_id, data, byte_len and, if quantized, the ends): their bytes in the file."""
    for batch in batches:
        ids, data, ends = batch.column("arc_id").to_pylist(), [], []
        for k, points in zip(ids, batch.column("points").to_pylist(), strict=True):
            p = np.array([(q["x"], q["y"]) for q in points], float).reshape(-1, 2)
            if quantized and (p != np.rint(p)).any():
                raise ValueError(f"arc {k} has fractions but a transform is given")
            data.append(varints(np.diff(p, axis=0, prepend=np.zeros((1, 2))).astype(np.int64).ravel())[0] if quantized else p.astype("<f8").tobytes())
            ends.append([*p[0], *p[-1]] if len(p) else [0.0] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary()), pa.array([len(x) for x in data], pa.int64()), pa.array(ends, pa.list_(pa.float64()))], ["arc_id", "data", "byte_len", "ends"])


def compress_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's arcs, in order, to one frame of their bytes and one of their ends (four channels of deltas)."""
    rows = rows.sort_values("arc_id")
    ends = np.array(rows["ends"].tolist(), float)
    frame = lambda x: zstandard.ZstdCompressor(level=19).compress(x)
    deltas_ = frame(varints(np.diff(ends, axis=0, prepend=np.zeros((1, 4))).astype(np.int64).ravel())[0]) if (ends == np.rint(ends)).all() else b""
    return pd.DataFrame({"block_id": [rows["block_id"].iloc[0]], "first": [rows["arc_id"].iloc[0]], "n_bytes": [int(rows["byte_len"].sum())], "frame": [frame(b"".join(rows["data"]))], "ends": [deltas_]})


def ordered_numbers(df: DataFrame, order: list[str], columns: list[str]) -> list[np.ndarray]:
    """Integer columns in that order; they come to the driver as bytes, not as rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(c)).astype("<i4").tobytes()], pa.binary()) for c in columns], columns)

    packed = df.orderBy(*order).select(*columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns))
    parts = [[bytes(x) for x in r] for r in packed.toLocalIterator()]
    return [np.frombuffer(b"".join(p[k] for p in parts), "<i4") for k in range(len(columns))]


def property_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted features to each column's values, compressed; a row without a name for each run of dense ids."""
    for batch in batches:
        layers, ids = batch.column("layer").to_pylist(), batch.column("geom_id").to_pylist()
        cuts = [k for k in range(len(ids)) if not k or layers[k] != layers[k - 1] or ids[k] != ids[k - 1] + 1]
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            flat = [dict(leaves(json.loads(x or "{}"))) for x in batch.column("properties")[a:b].to_pylist()]
            rows.append((layers[a], ids[a], b - a, None, None))
            for name in dict.fromkeys(n for x in flat for n in x):
                rows.append((layers[a], ids[a], b - a, name, zstandard.ZstdCompressor().compress(json.dumps([x.get(name) for x in flat]).encode())))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["layer", "first", "n", "name", "data"])


def write_container(tables: dict[str, DataFrame], path: str, transform: dict | None = None, bbox: tuple = (0, 0, 0, 0), target: int = TARGET, endpoints: bool = True) -> None:
    """arcs, arc_refs and features (properties as JSON text) to one file.

    With a transform, points are integers and stored as deltas, and (with `endpoints`) a
    section of arc ends is written. Nested properties become a/b columns. Arc and geometry
    ids must be dense; layer names hold no slash. Arcs are encoded and compressed in
    tasks; the driver puts compressed blocks and the columns together, as the file is one.
    """
    encoded = stored(tables["arcs"].select("arc_id", "points").mapInArrow(lambda b: encode_batches(b, bool(transform)), "arc_id int, data binary, byte_len long, ends array<double>"))
    span = encoded.agg(F.count("*").alias("n"), F.count_distinct("arc_id").alias("d"), F.min("arc_id").alias("a"), F.max("arc_id").alias("b")).first()
    if span.n and (span.d != span.n or span.a != 0 or span.b != span.n - 1):
        raise ValueError(f"arc ids aren't dense: {span.n} arcs, {span.d} ids from {span.a} to {span.b}")
    placed = stored(assign_blocks(encoded, target=target))
    made = encoded.join(placed.select("arc_id", "block_id"), "arc_id").groupBy("block_id").applyInPandas(compress_blocks, "block_id long, first int, n_bytes long, frame binary, ends binary")
    frames, table, at, end = [], [], 0, 0
    ends_frames, ends_table, ends_at = [], [], 0
    for r in made.orderBy("block_id").toLocalIterator():
        frames.append(bytes(r.frame))
        end += r.n_bytes
        table += [end, at, len(r.frame)]
        at += len(r.frame)
        ends_frames.append(bytes(r.ends))
        ends_table += [r.first, ends_at, len(r.ends)]
        ends_at += len(r.ends)
    sizes = ordered_numbers(placed, ["arc_id"], ["byte_len"])[0].astype(np.int64)
    discard(encoded, placed)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    sections = [("arc_coord_blocks", "u32", np.array(table, "<u4").tobytes(), False), ("arc_offsets", "u32", deltas(offsets), True)]
    layers, columns = [], []
    counts: dict[str, int] = {}
    values: dict[str, dict[str, list]] = {}
    chunks = tables["features"].select("layer", "geom_id", "properties").orderBy("layer", "geom_id").mapInArrow(property_batches, "layer string, first long, n long, name string, data binary")
    for r in chunks.toLocalIterator():
        if r.name is not None:
            values[r.layer].setdefault(r.name, []).append((r.first, r.n, bytes(r.data)))
            continue
        if "/" in r.layer or r.first != counts.setdefault(r.layer, 0):
            raise ValueError(f"layer {r.layer}: a slash in the name, or geometry ids that aren't dense")
        counts[r.layer] += r.n
        values.setdefault(r.layer, {})
    if unknown := {r.layer for r in tables["arc_refs"].select("layer").distinct().collect()} - set(counts):
        raise ValueError(f"references of layers without features: {sorted(unknown)}")
    for layer, n in counts.items():
        own = tables["arc_refs"].where((F.col("layer") == layer) & F.col("geom_id").between(0, n - 1))
        g, poly, ring, refs = ordered_numbers(own, ["geom_id", "poly_idx", "ring_idx", "pos"], ["geom_id", "poly_idx", "ring_idx", "arc_ref"])
        starts = np.flatnonzero(np.concatenate(([len(g) > 0], (np.diff(g) != 0) | (np.diff(poly) != 0) | (np.diff(ring) != 0)))[: len(g)])
        of, part = g[starts], poly[starts]
        breaks = 1 + np.flatnonzero((np.diff(of) == 0) & (np.diff(part) != 0))
        sections += [(f"{layer}/poly_offsets", "u32", deltas(np.searchsorted(of, np.arange(n + 1))), True), (f"{layer}/ring_offsets", "u32", deltas(np.append(starts, len(refs))), True), (f"{layer}/arc_refs", "i32", refs.tobytes(), False)]
        if len(breaks):
            sections.append((f"{layer}/multi_poly_breaks", "u32", np.column_stack([of[breaks], breaks]).astype("<u4").tobytes(), False))
        layers.append({"name": layer, "numGeometries": n})
        for name, found in values.pop(layer).items():
            if name in STRUCTURE:
                raise ValueError(f"a property can't be named {name}")
            column: list = [None] * n
            for first, m, data in found:
                column[first : first + m] = json.loads(zstandard.ZstdDecompressor().decompress(data))
            columns.append((f"{layer}/{name}", *pack_column(column), False))
    meta = {"version": 2, "numArcs": len(sizes), "bytesPerPoint": 8 if transform else 16, "transform": transform, "bbox": list(bbox)[:4], "layers": layers,
            "arcCoordsBlocks": {"blockTableSection": "arc_coord_blocks", "blockCount": len(frames), "targetBlockSize": target}}
    blobs = [("arc_coords", "blob", b"".join(frames), False)]
    if transform and endpoints and frames:
        sections.append(("arc_ends_blocks", "u32", np.array(ends_table, "<u4").tobytes(), False))
        blobs.append(("arc_endpoints", "blob", b"".join(ends_frames), False))
        meta["arcEndpointsBlocks"] = {"blockTableSection": "arc_ends_blocks", "partitionsSection": "arc_endpoints", "blockCount": len(frames)}
    assemble(path, meta, [*sections, *columns, *blobs], frozenset(x[0] for x in blobs))


def leaves(properties: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for k, v in properties.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{prefix}{k}/")
        else:
            yield prefix + k, v


def rewrite_container(source: str, path: str, overrides: dict[str, list]) -> None:
    """Copies a container with some property columns (by layer/name) replaced; blocks and partitions stay as they are."""
    c = Container(source)
    own = {f"{x}/{n}": c.layers[x]["numGeometries"] for x in c.layers for n in c.properties(x)}
    for name, values in overrides.items():
        if name not in own:
            raise ValueError(f"no property column {name}")
        if len(values) != own[name]:
            raise ValueError(f"{name} needs {own[name]} values")
    framed = [c.meta[k] for k in ("arcOffsetsBlocks", "arcEndpointsBlocks") if c.meta.get(k)] + [x["arcRefsBlocks"] for x in c.layers.values() if x.get("arcRefsBlocks")]
    sections = [(n, *pack_column(list(overrides[n])), False) if n in overrides else (n, s["type"], c.bytes_of(n), bool(s.get("delta"))) for n, s in c.sections.items()]
    assemble(path, c.meta, sections, frozenset({"arc_coords", *(x["partitionsSection"] for x in framed)}))
