"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's k-grams of words are hashed and each window of w neighbouring k-grams selects
its minima. Two texts that share k + w - 1 words in a row select the same k-grams there,
so with k + w - 1 = 10 no shared window of 10 words is missed. Selected hashes of
documents and items are joined, and each hit is extended word by word (by the words'
64-bit hashes); a run of 10 equal words or more around it is an occurrence. Items of
fewer words are found by their whole length, for each length that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, at_most, hot_from, join_counted, load, stored

#: Words in a window, in a k-gram, and k-grams in a winnowing window.
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Fingerprints of the benchmark up to this number (each has a fixed size, about 250 bytes) are broadcast, more
#: are joined by a shuffle in which each hash is dealt over SALTS tasks. Ids up to BROADCAST_IDS are broadcast.
BROADCAST_ROWS, SALTS, BROADCAST_IDS = 200_000, 16, 1_000_000
#: Fixed value: what lies between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    # lower() differs from lower-casing A-Z only where other letters occur
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))
    # a split takes a sixth of the time of regexp_extract_all; it gives empty words where a text begins or ends between words
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def up_to(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram(h: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(h, at + j) for j in range(k)])


def let(value: Column, body) -> Column:
    """body of value, which is computed once: the optimizer would copy it into each use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprints(hashes: Column, lengths: list[int]) -> Column:
    """Array of (len, at, hash) to look up, of the hashes of a text's words.

    len is 0 for selected k-grams, and a short item's length else, where every run of
    that many words is taken.
    """

    def selected(g: Column) -> Column:
        windows = F.transform(up_to(F.size(g) - W + 1), lambda i: F.least(*[F.get(g, i + j) for j in range(W)]))
        return let(windows, lambda m: F.filter(up_to(F.when(F.size(m) > 0, F.size(g)).otherwise(0)), lambda i: F.get(g, i) == F.greatest(*[F.get(m, i - j) for j in range(W)])))

    def every(h: Column, m: int) -> Column:
        return F.transform(up_to(F.size(h) - m + 1), lambda i: F.struct(F.lit(m).alias("len"), i.alias("at"), gram(h, i, m).alias("hash")))

    def of(h: Column) -> Column:
        grams = F.transform(up_to(F.size(h) - K + 1), lambda i: gram(h, i, K))
        parts = [let(grams, lambda g: F.transform(selected(g), lambda i: F.struct(F.lit(0).alias("len"), i.alias("at"), F.get(g, i).alias("hash"))))]
        parts += [every(h, m) for m in lengths]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(hashes, of)


def around(h: Column, at: Column) -> Column:
    """The hashes of the words from W - 1 before a k-gram to W - 1 behind it, null where the text ends."""
    return F.array(*[F.get(h, at + j) for j in range(1 - W, K + W - 1)])


def reach(h: Column, at: Column, near: Column, step: int, start: int) -> Column:
    """How many words agree beyond the hit, at most W - 1, going by `step` from `start`."""
    out = F.lit(W - 1)
    for j in reversed(range(W - 1)):
        same = F.get(h, at + start + step * j) == F.get(near, F.lit(W - 1 + start + step * j))
        out = F.when(F.coalesce(same, F.lit(False)), out).otherwise(j)
    return out


def grown(met: DataFrame, most: int) -> DataFrame:
    """(..., rep, span) of candidates (h, len, at, rep, near): the run of agreeing words, null where it isn't an occurrence."""
    k = F.when(F.col("len") == 0, K).otherwise(F.col("len"))
    agrees = F.lit(True)
    for j in range(most):
        agrees = agrees & ((k <= j) | F.coalesce(F.get("h", F.col("at") + j) == F.get("near", F.lit(W - 1 + j)), F.lit(False)))
    at, long = F.col("at"), F.col("len") == 0
    left = F.when(long, reach(F.col("h"), at, F.col("near"), -1, -1)).otherwise(0)
    right = F.when(long, reach(F.col("h"), at, F.col("near"), 1, K)).otherwise(0)
    out = met.select("doc_id", "text_hash", "n_words", "rep", (at - left).alias("start"), (at + k + right).alias("end"), (F.col("rep").isNotNull() & agrees).alias("ok"), long.alias("long"))
    hit = F.col("ok") & (~F.col("long") | (F.col("end") - F.col("start") >= WINDOW))
    return out.select("doc_id", "text_hash", "n_words", F.when(hit, F.col("rep")).alias("rep"), F.when(hit, F.struct("start", "end")).alias("span"))


def per_document(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit (words that spans cover), reps."""
    grouped = found.groupBy("doc_id", "text_hash", "n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("rep").alias("reps"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")))["n"]
    return grouped.select("doc_id", "text_hash", "n_words", covered.cast("long").alias("n_hit"), "reps")


def by_broadcast(read: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits are found and grown where the text is read; only what is found leaves its task."""
    # one row that stands for the document itself comes first
    self_row = F.array(F.struct(F.lit(-1).alias("len"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("hash")))
    tried = read.select("doc_id", "text_hash", "h", F.size("h").cast("long").alias("n_words"), F.concat(self_row, fingerprints(F.col("h"), lengths)).alias("hits"))
    tried = tried.select("doc_id", "text_hash", "n_words", "h", F.inline("hits"))
    met = tried.join(F.broadcast(prints), (F.col("hash") == F.col("item_hash")) & (F.col("len") == F.col("item_len")), "left").where("len = -1 OR rep IS NOT NULL")
    return per_document(grown(met, max(K, *lengths, 0)))


def by_shuffle(read: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """Only (document, place, hash) meets the benchmark; texts come back for documents with candidates alone."""
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(SALTS)).cast("int")
    tried = read.select("doc_id", "text_hash", F.inline(fingerprints(F.col("h"), lengths))).withColumn("salt", salt)
    side = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("item_salt"))
    met = tried.join(side, (F.col("hash") == F.col("item_hash")) & (F.col("len") == F.col("item_len")) & (F.col("salt") == F.col("item_salt")))
    met = stored(met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("len", "at", "rep", "near")).alias("hits")))
    ids = met.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))
    own = lambda d, t: F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("text_hash") == F.col(t))
    some = read.join(F.broadcast(ids), own("id", "th"), "left_semi") if at_most(ids, BROADCAST_IDS) else read
    held = some.dropDuplicates(["doc_id", "text_hash"]).join(met.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "hits"), own("id", "th"))
    held = held.select("doc_id", "text_hash", "h", F.size("h").cast("long").alias("n_words"), F.inline("hits"))
    hit = per_document(grown(held, max(K, *lengths, 0))).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), F.col("n_hit").alias("hit"), F.col("reps").alias("by"))
    every = read.select("doc_id", "text_hash", F.size("h").cast("long").alias("n_words")).distinct()
    out = every.join(hit, own("id", "th"), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("by", F.array().cast("array<string>")).alias("reps"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids), text_hash.

    Defined cases: null or empty texts have no words; an item without words never
    occurs; those with a null id count like others, as one in n_items, but have no name in items;
    items that repeat a text occur together; rows of docs that repeat
    doc_id and text give one row; a null doc_id is an id of its own; further columns are
    not used; with an empty benchmark nothing is contaminated.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    # a group of items without any id has a name of its own, which no other item's can be
    unnamed = F.concat(F.lit("\0"), F.sha2(F.array_join("words", " ").cast("binary"), 256))
    same = stored(items.groupBy("words").agg(F.min("item").alias("named"), F.collect_set("item").alias("items"), F.max(F.col("item").isNull().cast("long")).alias("nameless")).withColumn("rep", F.coalesce("named", unnamed)).drop("named"))
    lengths = [r[0] for r in same.select(F.size("words").alias("n")).where(f"n < {WINDOW}").distinct().orderBy("n").collect()]
    own = same.select("rep", F.transform("words", lambda x: F.xxhash64(x)).alias("h")).select("rep", "h", F.inline(fingerprints(F.col("h"), lengths)))
    prints = own.where(F.col("len") == F.when(F.size("h") < WINDOW, F.size("h")).otherwise(0)).select("rep", F.col("len").alias("item_len"), F.col("hash").alias("item_hash"), around(F.col("h"), F.col("at")).alias("near"))

    read = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    found = stored((by_broadcast if at_most(prints.select("rep"), broadcast_rows) else by_shuffle)(read, prints, lengths))

    named = found.where("size(reps) > 0").select("doc_id", "text_hash", F.explode("reps").alias("rep"))
    times = named.groupBy("rep").agg(F.count("*").alias("_n"))
    hot = hot_from(found.agg(F.sum(F.size("reps"))).first()[0] or 0)
    named = join_counted(named, times.join(same.select("rep", "items", "nameless"), "rep"), ["rep"], "_n", hot)
    named = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("nameless").alias("nameless"))
    key = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th"))
    with_items = found.where("size(reps) > 0").join(named.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "items", "nameless"), key).drop("id", "th")
    without = found.where("size(reps) = 0").select("*", F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("nameless"))
    out = with_items.unionByName(without)
    return out.select("doc_id", "n_words", "n_hit", (F.size("items") + F.col("nameless")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "text_hash")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("items", "text_hash")


SQL = {
    "op1_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
}
