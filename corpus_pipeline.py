"""The corpus pipeline: five stages, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. What a stage returns is written as Parquet and read again.

Defined cases: a null or empty text is never toxic, near another, contaminated or secret
and has no ids; decisions are by row (doc_id and text), so of texts that share a doc_id
each goes for what it says; rows that repeat doc_id and text stay or go together; without
labels nothing is toxic; an empty table stays empty; further columns, whatever their
names, stay as they are. By itself, the decontamination stage leaves rows without doc_id,
which it can't name; run() names them first, so there they go like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from arcloom.llm.common import at_most, discard, load, stored

#: Dropped documents up to this number are broadcast.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows that `dropped` names by doc_id (which can be null) and text_hash."""
    gone = stored(dropped.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    other = F.broadcast(gone) if at_most(gone, BROADCAST_IDS) else gone
    return docs.join(other, docs["doc_id"].eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_hash"]), "left_anti")


def packed(docs: DataFrame) -> DataFrame:
    """text, and all other columns as the struct `row`, so that no column of an operator's clashes with them."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    weights = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return unpacked(toxicity.score_toxicity(packed(docs), weights).where("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id stays of each group."""
    left = without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))
    # equal texts without an id are told apart by nothing: the first of them by its other columns stays
    nameless = left.where("doc_id IS NULL AND text <> ''")
    if nameless.isEmpty():
        return left
    row = F.struct(*[f"`{c}`" for c in left.columns])
    one = nameless.groupBy(F.xxhash64("text").alias("_h"), F.md5("text").alias("_m")).agg(F.min(row).alias("_row")).select(*[F.col(f"_row.`{c}`") for c in left.columns])
    return left.where("doc_id IS NOT NULL OR coalesce(text, '') = ''").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; others that share their doc_id, or have none, stay."""
    return without(docs, decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")).where("contaminated AND doc_id IS NOT NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    clean = secrets.scan_and_redact(packed(docs))
    n = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(clean.withColumn("row", F.col("row").withField("n_chars", n)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and whether they decode to the text again."""
    lexicon = bpe.compile_lexicon(spark, bpe.default_vocabulary(), bpe.frequent_words(docs))
    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    back = bpe.encode_and_decode(rows, lexicon)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.md5("text") == F.col("md5")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Training and minima have no SQL form; tests/llm/test_llm.py compares each stage but the first, whose held-out
#: accuracy is tested, with a brute-force version or its operator's SQL.
ORACLE_SQL = None


def named(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs with ids of their own for rows that have none, and the least of those; None where all rows have one.

    The table is stored, so that such an id stays what it is.
    """
    if docs.where("doc_id IS NULL").isEmpty():
        return docs, None
    base = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(base).cast("long") + F.monotonically_increasing_id())
    return stored(docs.withColumn("doc_id", own)), base


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs, base), before = named(load(spark, sf_dir, "documents")), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs if base is None else docs.withColumn("doc_id", F.when(F.col("doc_id") < base, F.col("doc_id")))


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
