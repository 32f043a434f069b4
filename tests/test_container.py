import json

import numpy as np
import pytest

from arcloom.sources import container as ct
from arcloom.sources.topojson import read_topology

TOPOLOGY = {
    "type": "Topology",
    "transform": {"scale": [0.5, 0.5], "translate": [1, 2]},
    "arcs": [[[0, 0], [3, 0], [0, 4]], [[300, -70000], [-1, 2]], [], [[5, 5], [1, 1], [-2, 0]]],
    "objects": {
        "a": {"type": "GeometryCollection", "geometries": [
            {"type": "Polygon", "arcs": [[0, -2]], "properties": {"n": 7, "s": "é", "d": {"x": 1.5}}},
            {"type": "Point", "properties": {"n": -3, "s": None}},
            {"type": "MultiPolygon", "arcs": [[[3], [0]], [[1, -1]]], "properties": {"n": 300, "s": "z", "d": {"x": 2}}},
        ]},
        "b": {"type": "GeometryCollection", "geometries": []},
    },
}


@pytest.mark.parametrize("quantized", [True, False])
def test_round_trip(spark, tmp_path, quantized):
    text = json.dumps(TOPOLOGY if quantized else {k: v for k, v in TOPOLOGY.items() if k != "transform"})
    tables, path = read_topology(spark, text), str(tmp_path / "t.bin")
    ct.write_container(tables, path, TOPOLOGY["transform"] if quantized else None, target=8)
    assert ct.read_container(spark, path).orderBy("arc_id").collect() == tables["arcs"].orderBy("arc_id").collect()
    order = ["layer", "geom_id", "poly_idx", "ring_idx", "pos"]
    assert ct.read_container(spark, path, "arc_refs").orderBy(order).collect() == tables["arc_refs"].orderBy(order).collect()
    assert [tuple(r) for r in ct.read_container(spark, path, "features", layer="a").orderBy("geom_id").collect()] == [(0, 7, "é", 1.5), (1, -3, "", 0.0), (2, 300, "z", 2.0)]
    assert ct.read_container(spark, path, ids="3,1,99").count() == 2
    assert ct.read_container(spark, path, "features", layer="a", columns="s").columns == ["geom_id", "s"]


def test_rewrite_and_errors(spark, tmp_path):
    path, other = str(tmp_path / "t.bin"), str(tmp_path / "u.bin")
    ct.write_container(read_topology(spark, json.dumps(TOPOLOGY)), path, TOPOLOGY["transform"])
    ct.rewrite_container(path, other, {"a/n": [1, 2, 3]})
    a, b = ct.Container(path), ct.Container(other)
    assert b.column("a/n") == [1, 2, 3] and b.sections["a/n"]["type"] == "u8" and a.sections["a/n"]["type"] == "i16"
    assert all(a.bytes_of(n) == b.bytes_of(n) for n in a.sections if n != "a/n")
    for bad in ({"a/q": [1]}, {"a/n": [1]}):
        with pytest.raises(ValueError):
            ct.rewrite_container(path, other, bad)
    data = (tmp_path / "t.bin").read_bytes()
    for k, broken in enumerate((b"XXXX" + data[4:], data[:7] + b"\x09" + data[8:], data[:20])):
        (tmp_path / f"bad{k}").write_bytes(broken)
        with pytest.raises(ValueError):
            ct.Container(str(tmp_path / f"bad{k}"))


def test_varints():
    v = np.array([0, -1, 1, 63, -64, 64, 2**31 - 1, -(2**31)])
    data, size = ct.varints(v)
    assert (ct.from_varints(data) == v).all() and size.tolist() == [1, 1, 1, 1, 1, 2, 5, 5] and data[:3] == b"\x00\x01\x02"
    for bad in (b"\xff\xff\xff\xff\x1f", b"\x80"):
        with pytest.raises(ValueError):
            ct.from_varints(bad)
    with pytest.raises(ValueError):
        ct.varints(np.array([2**31]))


def test_columns():
    assert [ct.pack_column(x)[0] for x in ([0, 255], [256], [70000, None], [-1], [-129], [-40000], [0.5], [True, False], ["a"], [None])] == ["u8", "u16", "u32", "i8", "i16", "i32", "f64", "u8", "strings", "strings"]
    for bad in ([1, "a"], [2**32], [[1]]):
        with pytest.raises(ValueError):
            ct.pack_column(bad)


def test_partitioned_sections(spark, tmp_path):
    """Offsets and references in frames, and two sections in one compressed region, as other writers store them."""
    import struct

    import zstandard

    tables, path, other = read_topology(spark, json.dumps(TOPOLOGY)), str(tmp_path / "t.bin"), str(tmp_path / "p.bin")
    ct.write_container(tables, path, TOPOLOGY["transform"], target=8)
    c, press = ct.Container(path), zstandard.ZstdCompressor().compress
    offsets, refs = c.arc_offsets(), c.arc_refs("a")
    parts, table, at = [], [], 0
    for a, b in ((0, 1), (1, 4)):
        parts.append(press(ct.deltas(offsets[a : b + 1] - offsets[a])))
        table += [a, at, len(parts[-1])]
        at += len(parts[-1])
    frames = [press(refs[:2].tobytes()), press(refs[2:].tobytes())]
    quads = [0, 0, len(frames[0]), 8, 2, len(frames[0]), len(frames[1]), refs[2:].nbytes]
    sections = [(n, s["type"], c.bytes_of(n), bool(s.get("delta"))) for n, s in c.sections.items() if n not in ("arc_offsets", "a/arc_refs")]
    sections += [("ob", "u32", np.array(table, "<u4").tobytes(), False), ("op", "blob", b"".join(parts), False), ("a/arc_refs_blocks", "u32", np.array(quads, "<u4").tobytes(), False), ("a/arc_refs_partitions", "blob", b"".join(frames), False)]
    meta = c.meta | {"arcOffsetsBlocks": {"blockTableSection": "ob", "partitionsSection": "op", "blockCount": 2}}
    meta["layers"] = [x | ({"arcRefsBlocks": {"blockTableSection": "a/arc_refs_blocks", "partitionsSection": "a/arc_refs_partitions", "blockCount": 2}} if x["name"] == "a" else {}) for x in meta["layers"]]
    ct.assemble(other, meta, sections, frozenset({"arc_coords", "op", "a/arc_refs_partitions"}))
    p = ct.Container(other)
    assert (p.arc_offsets() == offsets).all() and (p.arc_refs("a") == refs).all()
    assert ct.read_container(spark, other).orderBy("arc_id").collect() == tables["arcs"].orderBy("arc_id").collect()
    ct.rewrite_container(other, str(tmp_path / "q.bin"), {"a/n": [1, 2, 3]})
    assert (ct.Container(str(tmp_path / "q.bin")).arc_refs("a") == refs).all()
    region = struct.pack("<4i", 1, 2, 3, 4)
    small = press(region)
    p.at = lambda offset, length: small
    for k, name in enumerate(("g1", "g2")):
        p.sections[name] = {"type": "i32", "compression": "zst", "offset": -1, "length": len(small), "groupOffset": 8 * k, "groupLength": 8, "uncompressedRegionLength": 16}
    assert p.numbers("g1").tolist() == [1, 2] and p.numbers("g2").tolist() == [3, 4]


def test_topology_document_in_a_file(spark, tmp_path, monkeypatch):
    from arcloom.sources import topojson as tj

    path, out = tmp_path / "in", tmp_path / "out"
    layers = {"münze": [{"type": "MultiPolygon", "arcs": [[[0, 1], [2]], [[~2]]], "properties": {"id": "ä]}\"", "n": {"a": None}}}, {"type": "Point"}, {"type": "Polygon", "arcs": []}, *({"type": "Polygon", "arcs": [[k, ~0]], "properties": {"k": k}} for k in range(40))], "none": []}
    arcs = [[[0, 0], [1000, 0.5]], [[1e300, 0], [0, -1e-7]], [], [[5, 5, 9], [7, 7, 9]], *([[k, 1], [1, 1]] for k in range(40))]
    text = json.dumps({"bbox": [0], "objects": {k: {"geometries": v, "type": "GeometryCollection"} for k, v in layers.items()}, "arcs": arcs, "transform": {"scale": [1, 1], "translate": [0, 0]}}, indent=1, ensure_ascii=False)
    path.write_text(text)
    want, got = read_topology(spark, text), tj.load_topology(spark, str(path))
    tj.save_topology(want, str(out))
    assert json.loads(out.read_text()) == json.loads(tj.write_topology(want))
    for name, order in {"arcs": ["arc_id"], "features": ["layer", "geom_id"], "arc_refs": ["layer", "geom_id", "poly_idx", "ring_idx", "pos"]}.items():
        assert got[name].orderBy(*order).collect() == want[name].orderBy(*order).collect() and got[name].dtypes == want[name].dtypes
    # the same values from few bytes at a time and in small pieces
    monkeypatch.setattr(tj, "READ", 7)
    monkeypatch.setattr(tj, "PIECE", 40)
    for file in (path, out):
        found = {}
        for kind, layer, first, offset, length in tj.scanned(str(file)):
            if kind != "transform":
                values = found.setdefault((kind, layer), [])
                assert first == len(values)
                values += json.loads(b"[" + file.read_bytes()[offset : offset + length] + b"]")
        whole = json.loads(file.read_text())
        assert found == {("geometry", "münze"): whole["objects"]["münze"]["geometries"], ("arc", None): whole["arcs"]}
    for bad in ('{"arcs": []}', '{"arcs": [], "objects": {"x": {"type": "Polygon", "arcs": []}}}', '{"arcs": [], "objects": {}', '{"arcs": [], "arcs": [], "objects": {}}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            list(tj.scanned(str(path)))
