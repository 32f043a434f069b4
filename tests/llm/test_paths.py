"""Paths that only large tables take, on small ones, against the SQL of the queries or brute force."""

import duckdb
import pytest

from arcloom import storage
from arcloom.llm import chat_format, decontaminate, registry


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def wanted(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def run(name):
        found = con.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        return columns, sorted(found.fetchall(), key=repr)

    return run


def test_decontaminate_by_shuffle(spark, sf, wanted, monkeypatch):
    monkeypatch.setattr(storage, "HOT", 2)
    monkeypatch.setattr(storage, "MOST_HOT", 10**9)
    columns, want = wanted("op1_decontaminate")
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert rows_of(decontaminate.decontaminate(docs, items, broadcast_rows=1), columns) == want
    odd = spark.createDataFrame([(None, "x a b c y"), (1, "a B c d"), (1, None), (1, "a B c d"), (2, "")], "doc_id long, text string")
    short = spark.createDataFrame([("i", "a b"), ("j", "C"), (None, "b c d"), ("k", None)], "item_id string, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert rows_of(decontaminate.decontaminate(odd, short, broadcast_rows=1), names) == rows_of(decontaminate.decontaminate(odd, short), names)
    assert rows_of(decontaminate.decontaminate(odd, short), names) == sorted([(None, 5, 3, 2, ["i", "j"], True), (1, 4, 4, 3, ["i", "j"], True), (1, 0, 0, 0, [], False), (2, 0, 0, 0, [], False)], key=repr)


def test_no_words_in_the_exchange_of_the_shuffle(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = []
    kept = decontaminate.stored
    decontaminate.stored = lambda df: (seen.append(df), kept(df))[1]
    try:
        decontaminate.decontaminate(docs, items, broadcast_rows=1)
    finally:
        decontaminate.stored = kept
    hits = next(df for df in seen if "hits" in df.columns)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and all("words" not in line and "text#" not in line for line in exchanged)


def test_hot_conversations(spark, sf, wanted, monkeypatch):
    columns, want = wanted("op4_chat_format")
    monkeypatch.setattr(storage, "HOT", 6)
    monkeypatch.setattr(storage, "MOST_HOT", 10**9)
    assert rows_of(chat_format.op4_chat_format(spark, sf), columns) == want


def brute_substring(rows):
    """Words that stay of (order, text) rows, each text cut by what is before it."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        w = text.split()
        gone = set()
        for i in range(len(w) - 19):
            s = tuple(w[i : i + 20])
            if s in seen:
                gone.update(range(i, i + 20))
            seen.add(s)
        out[key] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.mark.parametrize("crowd", [1, 3, 20_000])
def test_substring_by_brute_force(spark, monkeypatch, crowd):
    """Groups of any size, and prefixes that are lengthened, over texts made of a few passages."""
    import random

    from arcloom.llm import substring_dedup

    rng = random.Random(crowd)
    passages = [[f"p{k}w{j}" for j in range(rng.randrange(15, 60))] for k in range(12)] + [["the"] * 50, ["a", "b"] * 30]
    rows = []
    for k in range(120):
        w = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(5, 60)] + [f"u{rng.randrange(10**6)}"] * rng.randrange(0, 3)
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(storage, "HOT", 4)
    monkeypatch.setattr(storage, "MOST_HOT", 10**9)
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    got = {r.doc_id: r.kept for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd).collect()}
    assert got == brute_substring(rows)


def test_substring_sql_with_lengthened_prefixes(spark, sf, wanted):
    from pyspark.sql import functions as F

    from arcloom.llm import substring_dedup

    columns, want = wanted("op8_substring_dedup")
    found = substring_dedup.substring_dedup(spark.read.parquet(f"{sf}/documents.parquet"), crowd=2)
    assert rows_of(found.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)), columns) == want


def brute_groups(rows, percent):
    """(doc_id, text) rows to the group of each: texts linked by their sets of 5-word shingles, wordless ones alone."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("crowd", [2, 500])
def test_near_duplicates_by_brute_force(spark, monkeypatch, crowd):
    """Repeated and null ids, and regions that have to go deeper."""
    import random

    from arcloom.llm import near_dedup

    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one"), (None, "one"), (4, "a b c d e f")]
    for c in range(6):
        base = [f"c{c}w{k}" for k in range(80)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            rows.append((rng.choice([None, rng.randrange(40)]), " ".join(w)))
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "BLOCK", crowd)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", crowd)
    monkeypatch.setattr(storage, "HOT", crowd)
    monkeypatch.setattr(storage, "MOST_HOT", 10**9)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert len(got) == len(rows)
    group = brute_groups(rows, 85)
    keyed = lambda d, t: (d, t)
    import xxhash  # noqa: F401

    hashes = {(r.doc_id, r.text): r.h for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    mine = {}
    for (d, t), g in zip(rows, group):
        mine.setdefault(g, []).append((d, hashes[keyed(d, t)], bool((t or "").split())))
    by_row = {(r.doc_id, r.text_hash): r for r in got}
    for members in mine.values():
        ids = [d for d, _, _ in members if d is not None]
        found = [by_row[d, h] for d, h, _ in members]
        assert {r.component_id for r in found} == {min(ids) if ids else None}
        assert len({(r.doc_id, r.text_hash) for r in found if r.kept}) == 1
        kept = next(r for r in found if r.kept)
        assert kept.doc_id == (min(ids) if ids else None)


def test_near_dedup_links_other_texts_of_an_id(spark):
    from arcloom.llm import near_dedup

    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b[:59], "z"]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False)]
