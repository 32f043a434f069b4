"""Near duplicates by MinHash in an LSH forest.

Texts with equal shingle sets are one class, of which one text is compared. Each tree of
the forest sorts all signatures by its own order of minima; neighbours whose common
prefix reaches the least depth are candidates. A region (equal prefix of the least depth)
that still holds several components is compared further: its members outside the largest
component against all, where they are few; where they are many, its members go deeper, to
groups of longer common prefixes, with as many more orders as the longer prefix needs.
Candidates are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import WordHashes, at_most, discard, hot_from, in_parts, join_counted, load, mix, runs_hash, stored, texts

#: Words in a shingle; minima that neighbours must share, and those of deeper groups, the last of which are compared whole.
SHINGLE, DEPTH, DEEPER = 5, 4, (8, 12, 16)
#: Probability with which the orders of one depth may miss a pair of the least similarity, and AGREE may.
MISS, UNLIKE = 1e-6, 1e-8
BYTES = 4
#: Rows on each side of a block. Members outside the largest component up to which a region is compared at its depth:
#: a set is copied to at most 2 * CROWD / BLOCK blocks. Ids up to BROADCAST_IDS are broadcast.
BLOCK, CROWD, BROADCAST_IDS = 500, 5_000, 1_000_000
#: Tasks over which the rows of a region are dealt.
SALTS = 16


@dataclass(frozen=True)
class Forest:
    """What follows from the least similarity: trees, minima in a signature, and how many must agree before sets are compared."""

    percent: int

    def orders(self, depth: int) -> int:
        """So many orders miss a pair that shares `depth` minima in none of them with probability MISS at most."""
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** depth)))

    @property
    def trees(self) -> int:
        return self.orders(DEPTH)

    @property
    def hashes(self) -> int:
        return self.trees * DEPTH

    @property
    def agree(self) -> int:
        """The most that all but UNLIKE of the pairs of the least similarity reach, minima being independent."""
        n, p, below = self.hashes, self.percent / 100, 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > UNLIKE:
                return k
        return n

    @property
    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        x = mix(np.arange(1, 2 * self.hashes + 1, dtype=np.uint64))
        return x[: self.hashes].astype(np.uint32) | np.uint32(1), x[self.hashes :].astype(np.uint32)

    def places(self, depth: int) -> np.ndarray:
        """For each order of that depth the minima that it looks at: drawn anew for each, by a fixed seed."""
        rng = np.random.default_rng(depth)
        return np.array([rng.permutation(self.hashes)[:depth] for _ in range(self.orders(depth))])


def shingles(text: bytes, cache: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; all words are one where there are fewer."""
    h = cache.of(text.lower().split())
    k = min(SHINGLE, len(h))
    return np.unique(runs_hash(h, k, seed=k)) if k else np.empty(0, np.uint64)


def minima(s: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> bytes:
    a, b = seeds
    out, x = np.full(len(a), 2**32 - 1, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        out = np.minimum(out, (x[at : at + 512, None] * a + b).min(axis=0))
    return out.astype(">u4").tobytes()


SKETCH = "doc_id long, text_hash long, n long, d1 long, d2 long, sig binary"


def sketch_batches(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    words, seeds = WordHashes(), forest.seeds
    for batch in in_parts(batches):
        rows = []
        for text in texts(batch):
            s = shingles(text, words)
            d = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
            rows.append((len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, minima(s, seeds) if len(s) else None))
        n, d1, d2, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], [x.split()[0] for x in SKETCH.split(", ")])


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to (rep, s), in batches of a few MB."""
    words = WordHashes()

    def give(reps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, sets)])
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "s"])

    for batch in in_parts(batches):
        reps, sets, size = [], [], 0
        for rep, text in zip(batch.column("rep").to_pylist(), texts(batch), strict=True):
            reps.append(rep)
            sets.append(shingles(text, words))
            size += len(sets[-1])
            if size > 1 << 20:
                yield give(reps, sets)
                reps, sets, size = [], [], 0
        if reps:
            yield give(reps, sets)


NEIGHBOURS = "pid int, edge int, tree int, prefix binary, a long, b long, na long, nb long"


def neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tree, label, rep, n) to pairs of neighbours; the partition's ends come along (edge 1 and 2)."""
    pid, names = TaskContext.get().partitionId(), [x.split()[0] for x in NEIGHBOURS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    last = None

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, rep, n = (np.asarray(batch.column(c)) for c in ("tree", "rep", "n"))
        prefix = [x[: DEPTH * BYTES] for x in batch.column("label").to_pylist()]
        if last is None:
            yield give([(pid, 1, int(tree[0]), prefix[0], int(rep[0]), int(rep[0]), int(n[0]), int(n[0]))])
        raw = np.frombuffer(b"".join(prefix), np.uint64).reshape(len(prefix), -1)
        same = np.flatnonzero((tree[1:] == tree[:-1]) & (raw[1:] == raw[:-1]).all(axis=1))
        rows = [(pid, 0, int(tree[k]), prefix[k], int(rep[k]), int(rep[k + 1]), int(n[k]), int(n[k + 1])) for k in same]
        if last is not None and last[0] == tree[0] and last[1] == prefix[0]:
            rows.append((pid, 0, int(tree[0]), prefix[0], last[2], int(rep[0]), last[3], int(n[0])))
        last = (int(tree[-1]), prefix[-1], int(rep[-1]), int(n[-1]))
        if rows:
            yield give(rows)
    if last is not None:
        yield give([(pid, 2, last[0], last[1], last[2], last[2], last[3], last[3])])


def neighbours(reps: DataFrame, forest: Forest, partitions: int) -> DataFrame:
    """Pairs (tree, prefix, a, b, na, nb) that are neighbours in some tree's order (stored)."""
    label = F.expr(f"substring(concat(sig, sig), tree * {DEPTH * BYTES} + 1, {2 * DEPTH * BYTES})")
    rows = reps.select("rep", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")).select("tree", label.alias("label"), "rep", "n")
    found = stored(rows.repartitionByRange(partitions, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep").mapInArrow(neighbour_batches, NEIGHBOURS))
    # two rows for each partition: its end meets the next one's start
    ends = found.where("edge > 0")
    w = Window.orderBy("pid", "edge")
    met = ends.select("tree", "prefix", "a", "na", "edge", *[F.lead(c).over(w).alias(f"{c}_next") for c in ("tree", "prefix", "a", "na", "edge")])
    met = met.where("edge = 2 AND edge_next = 1 AND tree = tree_next AND prefix = prefix_next")
    pairs = stored(found.where("edge = 0").select("tree", "prefix", "a", "b", "na", "nb").unionByName(met.select("tree", "prefix", "a", F.col("a_next").alias("b"), "na", F.col("na_next").alias("nb"))))
    discard(found)
    return pairs


def sets_of(reps: DataFrame, where: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, s): the full shingle sets of those classes (stored); `where` has doc_id and text_hash of one text of each."""
    some = stored(where.join(reps, "rep", "left_semi").select("rep", F.col("doc_id").alias("id"), F.col("text_hash").alias("th")))
    own = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th"))
    text = docs.join(F.broadcast(some) if at_most(some, BROADCAST_IDS) else some, own).select("rep", "text")
    found = stored(text.mapInArrow(set_batches, "rep long, s array<bigint>").dropDuplicates(["rep"]))
    discard(some)
    return found


def confirmed(pairs: DataFrame, where: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b), a < b, whose full sets are similar enough (stored)."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), where, docs)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    links = stored(linked.where(f"100 * i >= {percent} * (t - i)").select("a", "b"))
    discard(sets)
    return links


def ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) with a < b whose sizes allow the similarity."""
    return pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compare_block(rows: pd.DataFrame, percent: int, agree: int) -> pd.DataFrame:
    """Links between components, left block against right block, confirmed on full sets.

    A link between components that the block has already joined adds nothing, so a block
    gives fewer links than it has rows, and pairs within what is joined are passed over at once.
    """
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame([], columns=["a", "b"], dtype="int64")
    ls, rs = (np.frombuffer(b"".join(x["sig"]), ">u4").reshape(len(x), -1).astype(np.uint32) for x in (left, right))
    (lroot, lid, ln, lset), (rroot, rid, rn, rset) = ([x[c].to_numpy() for c in ("root", "x", "n", "s")] for x in (left, right))
    _, code = np.unique(np.concatenate([lroot, rroot]), return_inverse=True)
    lgroup, rgroup = code[: len(left)], code[len(left) :]
    name = np.arange(code.max() + 1)  # what each component is joined to by now
    out = []
    for k in range(len(left)):
        size = 100 * np.minimum(rn, ln[k]) >= percent * np.maximum(rn, ln[k])
        todo = np.flatnonzero(size & ((rs == ls[k]).sum(axis=1) >= agree))
        while len(todo := todo[name[rgroup[todo]] != name[lgroup[k]]]):
            j, todo = todo[0], todo[1:]
            shared = len(np.intersect1d(lset[k], rset[j], assume_unique=True))
            if 100 * shared >= percent * (ln[k] + rn[j] - shared):
                name[name == name[rgroup[j]]] = name[lgroup[k]]
                out.append((int(lid[k]), int(rid[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


REGION = ["tree", "prefix"]


def salted(rows: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """rows joined with few, where one key of few can have very many rows: dealt over SALTS tasks."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def unsettled(known: DataFrame) -> DataFrame:
    """known (tree, prefix, x, root) with largest (component), all and outside, of groups with several components (stored)."""
    sizes = known.groupBy(*REGION, "root").agg(F.count("*").alias("c")).groupBy(*REGION).agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"))
    sizes = sizes.where("top.c < all").select(*REGION, F.col("top.root").alias("largest"), "all", (F.col("all") - F.col("top.c")).alias("outside"))
    return stored(salted(known, sizes, REGION, "x"))


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))


def deeper_batches(batches: Iterator[pa.RecordBatch], forest: Forest, depth: int) -> Iterator[pa.RecordBatch]:
    """(x, root, sig) to (tree, prefix, x, root) for each order of that depth; the prefix is a 64-bit hash of the order's minima."""
    places, base = forest.places(depth), np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, root = batch.column("x"), batch.column("root")
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(len(x), -1).astype(np.uint64)
        ends = pa.py_buffer((8 * np.arange(len(x) + 1)).astype(np.int32))
        for tree, at in enumerate(places):
            key = np.zeros(len(x), np.uint64)
            for k in at:
                key = mix(key * base + sig[:, k] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(key)]), x, root], [*REGION, "x", "root"])


def compared(members: DataFrame, reps: DataFrame, where: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """Links of groups' members outside the largest component with all members, in blocks of BLOCK against BLOCK (stored)."""
    sets = sets_of(members.select(F.col("x").alias("rep")).distinct(), where, docs)
    rows = members.withColumn("nl", F.ceil(F.col("outside") / BLOCK).cast("int")).withColumn("nr", F.ceil(F.col("all") / BLOCK).cast("int"))
    rows = rows.join(reps.select(F.col("rep").alias("x"), "n", "sig"), "x").join(sets.withColumnRenamed("rep", "x"), "x")
    block = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("root <> largest").select(*REGION, block("nl").alias("l"), each("nr").alias("r"), F.lit(0).alias("side"), "x", "root", "n", "sig", "s")
    right = rows.select(*REGION, each("nl").alias("l"), block("nr").alias("r"), F.lit(1).alias("side"), "x", "root", "n", "sig", "s")
    links = stored(left.unionByName(right).groupBy(*REGION, "l", "r").applyInPandas(lambda rows: compare_block(rows, forest.percent, forest.agree), "a long, b long"))
    discard(sets)
    return links


def crowded(near: DataFrame, roots: DataFrame, reps: DataFrame, where: DataFrame, docs: DataFrame, forest: Forest) -> list[DataFrame]:
    """Further links in regions that still hold several components, region by region at the depth that suits it."""
    wide = near.groupBy(*REGION).agg(F.count("*").alias("c")).where("c > 1").select(*REGION)
    members = salted(near.select(*REGION, "a", "b"), wide, REGION, "a").select(*REGION, F.explode(F.array("a", "b")).alias("x")).distinct()
    known, links = with_roots(members, roots), []
    for depth in (*DEEPER, None):
        open_ = unsettled(known)
        crowd = open_.where(F.col("outside") > CROWD)
        last = depth is None or crowd.isEmpty()
        links.append(compared(open_ if last else open_.where(F.col("outside") <= CROWD), reps, where, docs, forest))
        if last:
            break
        # what they share at this depth is not enough to tell them apart: all orders of the next depth, over these members only
        if not links[-1].isEmpty():
            roots = joined_roots(roots, links[-1])
        some = with_roots(crowd.select("x").distinct(), roots).join(reps.select(F.col("rep").alias("x"), "sig"), "x")
        known = some.mapInArrow(lambda b, d=depth: deeper_batches(b, forest, d), "tree int, prefix binary, x long, root long")
    return links


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after further links: each known node is a link to its root."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for each row of docs (doc_id, text).

    Linked are texts with 100 * shared shingles >= percent * all shingles of both; a
    component is what links reach, and its id its smallest doc_id. Rows are told apart by
    their text as well as by doc_id: other texts under one id, or without any, are linked by
    what they say. Of each component one document is kept, that of the smallest doc_id (without
    any comes last; of several texts under it, that of the smallest digest); rows that
    repeat doc_id and text are one document and kept or not together, as often as given.
    Null or wordless texts are linked with nothing and kept; an empty table gives no rows;
    further columns are not used. Trees, depth and AGREE follow from `percent`; below 80
    they would grow too many, so a smaller one raises.
    """
    if percent < 80:
        raise ValueError(f"percent is {percent}; links below 80 would be missed")
    forest = Forest(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    spark = docs.sparkSession
    sketch = stored(docs.mapInArrow(lambda b: sketch_batches(b, forest), SKETCH))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2", "text_hash")
    # a class's number is made once, where the table is stored
    classes = sketch.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(first).alias("first"), F.min_by("sig", first).alias("sig"), F.count("*").alias("rows"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    reps, where = classes.select("rep", "n", "sig"), classes.select("rep", "first.doc_id", "first.text_hash")
    near = neighbours(reps, forest, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tested = stored(ordered(near, percent))
    links = confirmed(tested, where, docs, percent)
    discard(tested)
    roots = components(links)
    more = crowded(near, roots, reps, where, docs, forest)
    discard(near)
    for found in more:
        if not found.isEmpty():
            links = links.unionByName(found)
    if len(more) > 1 or not more[0].isEmpty():
        roots = components(links)
    # a component's first document; d1 and d2 tell other texts under its id apart
    member = classes.select("rep", "d1", "d2", "n", "rows", "first").join(roots, classes["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    tops = member.groupBy("root").agg(F.min("first").alias("top"), F.count("*").alias("times"))
    n_classes = classes.count()
    member = stored(join_counted(member.select("root", "d1", "d2", "n", "rows"), tops, ["root"], "times", hot_from(n_classes)).select("d1", "d2", F.col("n").alias("cn"), "rows", "top"))
    out = join_counted(sketch.where("n > 0").select("doc_id", "text_hash", F.col("n").alias("cn"), "d1", "d2"), member, ["d1", "d2", "cn"], "rows", hot_from(sketch.count()))
    kept = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("d1") == F.col("top.d1")) & (F.col("d2") == F.col("top.d2"))
    out = out.select("doc_id", F.col("cn").alias("n_shingles"), F.col("top.doc_id").alias("component_id"), kept.alias("kept"), "text_hash")
    return out.unionByName(sketch.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), percent=85).drop("text_hash")


SQL = {
    "op2_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' '), least(5, len(w))) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
}
