"""Substring dedup by suffix trees over prefix partitions.

Suffixes are dealt to groups by a prefix and each group's subtree is built by itself; the
nodes at the depth of a window (20 words) or deeper are the repeats, and of each node's
leaves all but the earliest start repeated windows, whose words go.

The prefix of a window is the least (by hash) of the 8-word sequences in it, so equal
windows share it and neighbouring windows mostly do: they travel together as one run of
words. A prefix that occurs once has no inner node and takes no part. A group fits a task's
memory: a prefix with more places than that is lengthened to the whole window, where the
node itself is the group and only its earliest leaf has to be known. A subtree is built
from the top: at each step its groups are split by their next words, and what is alone in
its group is a leaf and leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, at_most, discard, hot_from, join_counted, load, mix, runs_hash, sha, stored, texts

#: Words in a window and in a prefix; prefixes in a window; depths to which a subtree is split, step by step.
WINDOW, PREFIX = 20, 8
INSIDE = WINDOW - PREFIX + 1
DEPTHS = (8, 14, 20)
#: Places of a prefix up to which its group is a subtree in one task; places that a task handles at once.
CROWD, CHUNK = 20_000, 40_000
#: Ids up to this number are broadcast.
BROADCAST_IDS = 1_000_000
#: What tells documents apart, in their order. `own` is 0 where the id alone does, below 0 where texts differ
#: under one id, and above 0 without an id.
KEY, KEY_TYPE = ["doc_id", "own"], "doc_id long, own long"


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out, have = pick(out[:-have], out[have:]), 2 * have
    return pick(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's prefixes, and for each window the place of its least one (the first of equal ones)."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = runs_hash(h, PREFIX)
    least = sliding(g, INSIDE, np.minimum)
    pad = np.zeros(INSIDE - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), INSIDE, np.maximum) == g)
    first = np.searchsorted(at, np.arange(len(least)))
    while (off := g[at[first]] != least).any():
        first += off
    return g, at[first]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def keys_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(batch.column(c).to_pylist(), np.int64) for c in KEY]


def prefix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        at, prefix = [], []
        for text in texts(batch):
            g, own = anchors(cache.of(text.split()))
            own = np.unique(own)
            at.append(own.astype(np.int32))
            prefix.append(g[own])
        if at:
            sizes = [len(x) for x in at]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(k, sizes)) for k in keys_of(batch)), pa.array(np.concatenate(at)), pa.array(np.concatenate(prefix).view(np.int64))], [*KEY, "at", "prefix"])


RUNS = f"{KEY_TYPE}, at int, n int, prefix long, w1 long, w2 long, words binary"


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of repeated prefixes (`at`; `crowded` ones too) to runs of windows.

    A run is n windows from word `at` on that share a place of a prefix, with its words'
    hashes. A window of a crowded prefix comes alone, with two hashes of all its words.
    """
    cache = WordHashes()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RUNS.split(", ")]
    for batch in batches:
        doc, own = keys_of(batch)
        for i, (text, some, crowd) in enumerate(zip(texts(batch), batch.column("at").to_pylist(), batch.column("crowded").to_pylist(), strict=True)):
            h = cache.of(text.split())
            g, anchor = anchors(h)
            single = np.flatnonzero(np.isin(anchor, crowd)) if crowd else np.empty(0, np.int64)
            window = np.flatnonzero(np.isin(anchor, some))
            if crowd:
                window = window[~np.isin(anchor[window], crowd)]
            # neighbouring windows with one anchor are a run
            new = np.flatnonzero(np.diff(anchor[window], prepend=-1) != 0)
            at, n = window[new], np.diff(np.append(new, len(window)))
            if len(at):
                size = n + WINDOW - 1
                flat = h[spread(at, size)]
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * np.concatenate(([0], np.cumsum(size)))).astype(np.int32)), pa.py_buffer(flat)])
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc[i])), pa.array(np.full(len(at), own[i])), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(g[anchor[at]].view(np.int64)), none, none, data], names)
            if len(single):
                w = [pa.array(runs_hash(h, WINDOW, seed)[single].view(np.int64)) for seed in (1, 2)]
                none, one = pa.nulls(len(single), pa.int64()), np.ones(len(single), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(single), doc[i])), pa.array(np.full(len(single), own[i])), pa.array(single.astype(np.int32)), pa.array(one), none, *w, pa.nulls(len(single), kinds[-1])], names)


LATER = f"{KEY_TYPE}, at int, n int"


def subtrees(prefix: np.ndarray, doc: np.ndarray, own: np.ndarray, at: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of whole groups to (run, at, n) of what isn't the earliest leaf of a node of a window's depth.

    `words` has the n + 19 hashes of each run, one after the other.
    """
    size = n + WINDOW - 1
    row = np.repeat(np.arange(len(n)), n)
    place = spread(np.cumsum(size) - size, n)  # of each window in words
    live = np.arange(len(row))
    group = np.unique(prefix, return_inverse=True)[1][row].astype(np.uint64)
    down = 0
    for depth, seed in (*((d, 0) for d in DEPTHS), (WINDOW, 1)):
        key = mix(group + np.uint64(1 + seed))
        # the last step looks at all words again by another hash, so that a node is 128 bits sure
        for k in range(0 if seed else down, depth):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + words[place[live] + k])
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        inner = count[group] > 1
        live, group, down = live[inner], group[inner].astype(np.uint64), depth
    start = at[row[live]] + (place[live] - (np.cumsum(size) - size)[row[live]])
    order = np.lexsort((start, own[row[live]], doc[row[live]], group))
    earliest = np.append(True, group[order][1:] != group[order][:-1])[: len(order)]
    later = np.zeros(len(row) + 1, bool)
    later[live[order[~earliest]]] = True
    # neighbouring windows of a run are one row again
    new_row = np.append(True, row[1:] != row[:-1])[: len(row)]
    begin = np.flatnonzero(later[:-1] & (new_row | ~np.append(False, later[:-2])[: len(row)]))
    stop = np.flatnonzero(later[:-1] & (np.append(new_row[1:], True)[: len(row)] | ~later[1:]))
    first = at[row[begin]] + (place[begin] - (np.cumsum(size) - size)[row[begin]])
    return row[begin], first, stop - begin + 1


def own_data(column: pa.Array) -> np.ndarray:
    """The hashes of all values of a binary column, without those before or behind a slice."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)


def subtree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by prefix to those parts of them that are later leaves; a chunk ends where a prefix does."""
    held: list[pa.RecordBatch] = []

    def give(table: pa.Table) -> pa.RecordBatch | None:
        c = {x: np.asarray(table.column(x).combine_chunks()) for x in ("prefix", "doc_id", "own", "at", "n")}
        words = np.concatenate([own_data(x) for x in table.column("words").chunks])
        run, at, n = subtrees(c["prefix"], c["doc_id"], c["own"], c["at"].astype(np.int64), c["n"].astype(np.int64), words)
        if not len(run):
            return None
        return pa.RecordBatch.from_arrays([pa.array(c["doc_id"][run]), pa.array(c["own"][run]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], [*KEY, "at", "n"])

    def rows() -> int:
        return sum(x.num_rows for x in held)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if rows() < CHUNK:
            continue
        prefix = np.asarray(batch.column("prefix"))
        cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
        if cut:
            held[-1] = batch.slice(0, cut)
            if (out := give(pa.Table.from_batches(held))) is not None:
                yield out
            held = [batch.slice(cut)]
    if held and (out := give(pa.Table.from_batches(held))) is not None:
        yield out


KEPT = f"{KEY_TYPE}, n_words long, n_removed long, kept string"


def keep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with `runs` (at, n) of repeated windows (null: none) and `copy` (all windows are repeated) to kept words."""
    for batch in batches:
        n, gone, out = [], [], []
        for text, runs, copy in zip(texts(batch), batch.column("runs").to_pylist(), batch.column("copy").to_pylist(), strict=True):
            words = text.split()
            drop = np.zeros(len(words) + 1, np.int64)
            if copy and len(words) >= WINDOW:
                drop[0] = 1
            elif runs:
                at, size = np.array([(r["at"], r["n"]) for r in runs]).T
                np.add.at(drop, at, 1)
                np.add.at(drop, at + size - 1 + WINDOW, -1)
            removed = np.cumsum(drop)[: len(words)] > 0
            n.append(len(words))
            gone.append(int(removed.sum()))
            out.append(b" ".join(words if not gone[-1] else [words[k] for k in np.flatnonzero(~removed)]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [*KEY, "n_words", "n_removed", "kept"])


def among(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return df.join(F.broadcast(ids) if at_most(ids, BROADCAST_IDS) else ids, KEY, how)


def with_own(docs: DataFrame) -> DataFrame:
    """doc_id (2**63 - 1 for null), own and text."""
    digest = F.xxhash64("text")
    many = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias("many")))
    marked = docs.join(F.broadcast(many) if at_most(many, BROADCAST_IDS) else many, "doc_id", "left")
    positive = F.greatest(F.lit(1).cast("long"), digest.bitwiseAND(F.lit(2**63 - 1)))
    own = F.when(F.col("doc_id").isNull(), positive).when(F.col("many"), -positive).otherwise(F.lit(0).cast("long"))
    return marked.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), own.alias("own"), "text")


def substring_dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space).

    A word goes if a window of 20 words covers it whose sequence also starts earlier: in a
    row of smaller doc_id, or earlier in the same one. Null or empty texts have no words;
    texts of fewer than 20 words stay whole; a null doc_id comes after all others; rows
    that repeat doc_id and text are one document and come back as often as given; other
    texts under one doc_id, or without any, are documents of their own, in the order of
    a 63-bit hash; further columns are not used; an empty table gives no rows. `crowd` is
    how many places of a prefix make a group that one task holds.
    """
    docs = with_own(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    key = F.struct(*KEY)
    keyed = docs.select(*KEY, F.md5("text").alias("digest"))
    firsts = stored(keyed.groupBy("digest").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n"))
    # of texts that are equal all but the first go whole; they take no part in what follows
    copies = stored(join_counted(keyed, firsts, ["digest"], "n", hot_from(docs.count())).where(key > F.col("first")).select(*KEY).distinct())
    discard(firsts)
    unique = among(docs, copies, "left_anti")

    prefixes = stored(unique.mapInArrow(prefix_batches, f"{KEY_TYPE}, at int, prefix long"))
    inner = prefixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").withColumn("crowded", F.col("n") > crowd)
    places = join_counted(prefixes, inner, ["prefix"], "n", hot_from(prefixes.count()))
    places = stored(places.groupBy(*KEY).agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("crowded"), F.col("at"))).alias("crowded")))
    discard(prefixes)
    runs = stored(among(unique, places.select(*KEY), "left_semi").join(places, KEY).select(*KEY, "text", "at", "crowded").mapInArrow(run_batches, RUNS))
    discard(places)

    groups = runs.where("prefix IS NOT NULL").select("prefix", *KEY, "at", "n", "words")
    later = groups.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(subtree_batches, LATER)
    alone = runs.where("prefix IS NULL").select(*KEY, "at", "n", "w1", "w2")
    if n_alone := alone.count():
        nodes = alone.groupBy("w1", "w2").agg(F.min(F.struct(*KEY, "at")).alias("first"), F.count("*").alias("leaves")).where("leaves > 1")
        repeated = join_counted(alone, nodes, ["w1", "w2"], "leaves", hot_from(n_alone)).where(F.struct(*KEY, "at") > F.col("first"))
        later = later.unionByName(repeated.select(*KEY, "at", "n"))
    gone = stored(later.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    discard(runs)

    hit = gone.select(*KEY)
    no_runs = F.lit(None).cast("array<struct<at:int,n:int>>").alias("runs")
    rest = among(unique, hit, "left_anti").select(*KEY, "text", no_runs, F.lit(False).alias("copy"))
    cut = among(unique, hit, "left_semi").join(gone, KEY).select(*KEY, "text", "runs", F.lit(False).alias("copy"))
    whole = among(docs, copies, "left_semi").select(*KEY, "text", no_runs, F.lit(True).alias("copy"))
    out = rest.unionByName(cut).unionByName(whole).mapInArrow(keep_batches, KEPT)
    return out.select(F.when(F.col("own") <= 0, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT p.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
}
