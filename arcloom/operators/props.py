"""Typed property columns: profiles, defaults, overrides, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dtype_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, dtype) of each column as the container stores it: one pass over all columns."""
    aggs = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            aggs.append(F.lit("strings").alias(c))
            continue
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise ValueError(f"{c}: {kind.simpleString()} is not a property type")
        v = F.col(c).cast("double") if not isinstance(kind, T.BooleanType) else F.col(c).cast("int").cast("double")
        whole = F.coalesce(F.bool_and((v == F.floor(v)) & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(True))
        low, high = F.min(v), F.max(v)
        dtype = F.when(F.count(v) == 0, "strings").when(~whole, "f64").when(low >= 0, F.when(high <= 255, "u8").when(high <= 65535, "u16").otherwise("u32"))
        aggs.append(dtype.when((low >= -128) & (high <= 127), "i8").when((low >= -32768) & (high <= 32767), "i16").otherwise("i32").alias(c))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("dtype")) for c in columns])).alias("p")).select("p.*")


def with_defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become 0, missing strings empty."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("" if isinstance(df.schema[c].dataType, T.StringType) else 0).cast(df.schema[c].dataType)) for c in columns})


def override(features: DataFrame, name: str, values: DataFrame, default=0) -> DataFrame:
    """features with column `name` from values (geom_id, name); default where missing. Unknown names raise."""
    if name not in values.columns:
        raise ValueError(f"no column {name}")
    return features.drop(name).join(values.select("geom_id", name), "geom_id", "left").fillna({name: default})


def flatten(df: DataFrame, column: str = "properties") -> DataFrame:
    """A struct's leaves as columns named by path, a/b."""
    out = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, [*path, f.name])
            elif isinstance(f.dataType, T.ArrayType):
                raise ValueError(f"array property {'/'.join([*path[1:], f.name])}")
            else:
                out.append(F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias("/".join([*path[1:], f.name])))

    walk(df.schema[column].dataType, [column])
    return df.select(*[c for c in df.columns if c != column], *out)


def nest(df: DataFrame, columns: list[str], column: str = "properties") -> DataFrame:
    """The inverse of flatten."""
    def build(names: list[tuple[list[str], str]]):
        heads: dict[str, list] = {}
        for path, name in names:
            heads.setdefault(path[0], []).append((path[1:], name))
        return F.struct(*[(F.col(f"`{v[0][1]}`") if not v[0][0] else build(v)).alias(k) for k, v in heads.items()])

    return df.select(*[c for c in df.columns if c not in columns], build([(c.split("/"), c) for c in columns]).alias(column))
