"""Tables in the folder that driver and executors share, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which on a key counts as hot, and how many hot keys there can be.
HOT, MOST_HOT = 50_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the session names; a temporary one only where none is set and everything
    runs in one process. A cluster without such a folder raises.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arcloom-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends here and survives executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` gave, once all that was made from them is stored too."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most `bound` rows; reads no more than it must."""
    return df.limit(bound + 1).count() <= bound


def hot_from(rows: int) -> int | None:
    """The count from which on a key is hot, such that at most MOST_HOT keys of `rows` rows are; None if none can be."""
    return max(HOT, -(-rows // MOST_HOT)) if rows >= HOT else None


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], count: str, hot: int | None, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for each key and in `count` how many of rows have that key.

    Hot groups are broadcast, as `hot` (see hot_from) bounds their number; all others meet
    their rows in a shuffle, where no key has `hot` rows. `count` is dropped. `how` is inner or left.
    """
    if hot is None:
        return rows.join(groups.drop(count), on, how)
    many = groups.where(F.col(count) >= hot).drop(count).withColumn("_hot", F.lit(True))
    if many.isEmpty():
        return rows.join(groups.drop(count), on, how)
    marked = rows.join(F.broadcast(many), on, "left")
    own = [c for c in groups.columns if c not in (*on, count)]
    few = marked.where("_hot IS NULL").drop("_hot", *own).join(groups.where(F.col(count) < hot).drop(count), on, how)
    return marked.where("_hot").drop("_hot").unionByName(few)
