"""Column expressions on arc references, points, rings and integers; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells on a side of the Hilbert grid.
GRID = 1 << 16
MOD = 1 << 32


def let(value: Column, body) -> Column:
    """body of value, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def arc_id(ref: Column) -> Column:
    """A reference below 0 means arc -ref - 1, reversed."""
    return F.when(ref < 0, F.bitwise_not(ref)).otherwise(ref)


def forward(ref: Column) -> Column:
    return ref >= 0


def signed_ref(arc: Column, is_forward: Column) -> Column:
    return F.when(is_forward, arc).otherwise(F.bitwise_not(arc))


def transform(x: Column, y: Column, scale: tuple[float, float] | None, translate: tuple[float, float] | None) -> Column:
    """Quantized to real coordinates; without a transform, as given."""
    if scale is None:
        return F.struct(x.alias("x"), y.alias("y"))
    return F.struct((x * F.lit(float(scale[0])) + F.lit(float(translate[0]))).alias("x"), (y * F.lit(float(scale[1])) + F.lit(float(translate[1]))).alias("y"))


def untransform(x: Column, y: Column, scale: tuple[float, float] | None, translate: tuple[float, float] | None) -> Column:
    """Real to quantized coordinates, not rounded."""
    if scale is None:
        return F.struct(x.alias("x"), y.alias("y"))
    return F.struct(((x - F.lit(float(translate[0]))) / F.lit(float(scale[0]))).alias("x"), ((y - F.lit(float(translate[1]))) / F.lit(float(scale[1]))).alias("y"))


def zigzag(v: Column) -> Column:
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def varint_length(v: Column) -> Column:
    """Bytes of the zigzag LEB128 form."""
    z = zigzag(v)
    out = F.when(z < 1 << 7, 1)
    for k in range(2, 5):
        out = out.when(z < 1 << (7 * k), k)
    return out.otherwise(5)


def grid_cell(v: Column, low: Column, high: Column) -> Column:
    """The cell of v among GRID between low and high; the scale is computed first."""
    span = high - low
    scale = F.lit(GRID - 1.0) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return F.least(F.greatest((v - low) * scale, F.lit(0.0)), F.lit(GRID - 1.0)).cast("int")


def hilbert_key(x: Column, y: Column, n: int = GRID) -> Column:
    """The place of cell (x, y) on the Hilbert curve over n by n cells, n a power of 2."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length() - 1))])

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["x"].bitwiseAND(s) > 0, 1).otherwise(0)
        ry = F.when(a["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        d = a["d"] + s.cast("long") * s * (rx * 3).bitwiseXOR(ry)
        mx = F.when(rx == 1, s - 1 - a["x"]).otherwise(a["x"])
        my = F.when(rx == 1, s - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, my).otherwise(a["x"]).alias("x"), F.when(ry == 0, mx).otherwise(a["y"]).alias("y"), d.alias("d"))

    start = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(steps, start, step)["d"]


def directed(points: Column, ref: Column) -> Column:
    return F.when(ref >= 0, points).otherwise(F.reverse(points))


def without_last(points: Column) -> Column:
    return F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))


def close(points: Column) -> Column:
    """The first point again at the end."""
    return F.concat(points, F.slice(points, 1, 1))


def rotated(a: Column, key: Column) -> Column:
    """The array a, starting at the place where key (as long as a) is least."""
    return let(F.array_position(key, F.array_min(key)).cast("int"), lambda p: F.concat(F.slice(a, p, F.size(a)), F.slice(a, 1, p - 1)))


def least_first(ring: Column) -> Column:
    """A closed ring, starting (and ending) at its least point."""
    return let(without_last(ring), lambda r: F.when(F.size(r) > 0, close(rotated(r, r))).otherwise(ring))


def signed_area2(ring: Column) -> Column:
    """Twice the signed area, summed from the first point to the last."""
    pairs = F.sequence(F.lit(0), F.size(ring) - 2)
    def add(a: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        return a + (p["x"] * q["y"] - q["x"] * p["y"])

    return F.when(F.size(ring) > 1, F.aggregate(pairs, F.lit(0.0), add)).otherwise(0.0)


def area2(ring: Column) -> Column:
    return F.abs(signed_area2(ring))
