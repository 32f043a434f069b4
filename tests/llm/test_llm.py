import hashlib
import json
import re
import zlib
from base64 import b64encode, urlsafe_b64encode

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.llm import chat_format, decontaminate, licenses, media, near_dedup, registry, secrets, substring_dedup, toxicity, url_filter

ODD = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (None, "null id text " * 9, "x"), (4, "a b c d e f g h i j k l " * 4, "x"), (4, "a b c d e f g h i j k l " * 4, "x"), (5, "A B C D e f g h i j k l " * 4, None), (6, "w%d " % 7 * 30_000, "x"), (7, "<s>\\é日 🎉\n" * 50, "x")]
SCHEMA = "doc_id long, text string, rep string"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].astype(object).where(got[columns].notna(), None).values.tolist())) == sorted(map(repr, want[columns].astype(object).where(want[columns].notna(), None).values.tolist()))


OPERATORS = {
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "c D e f"), (2, None), (None, "x"), (3, "")], "item_id long, text string")),
    "substring": lambda s, d: substring_dedup.substring_dedup(d),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, np.zeros((1 << toxicity.BITS) + 1)),
    "media": lambda s, d: media.store_payloads(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](spark, spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(got) in (len(ODD), len(ODD) - 1)
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_dedup_links(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join([*base[:59], "other"])), (13, " ".join(base[::-1])), (14, None), (15, "")]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert [got[k].component_id for k in range(10, 16)] == [10, 10, 10, 13, 14, 15]
    assert [got[k].kept for k in range(10, 16)] == [True, False, False, True, True, True]


def test_near_dedup_refuses_small_percent(spark):
    with pytest.raises(ValueError, match="79"):
        near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA), 79)


def test_substring_null_and_repeated_ids(spark):
    """Each text is cut by what is before it only, whatever others share its id or lack one too."""
    run = lambda w, n: " ".join(f"{w}{k}" for k in range(n))
    a, b, c, d, e = (run(x, n) for x, n in (("a", 40), ("b", 30), ("c", 25), ("d", 90), ("e", 60)))
    rows = [(1, a), (2, b), (None, a), (None, c), (None, f"{d} {b}"), (None, "short"), (5, d + " x " + c), (5, e), (5, e + " y"), (6, e), (2**63 - 1, c), (None, c)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    fixed = [(1, 40, 0, a), (2, 30, 0, b), (0, 40, 40, ""), (0, 25, 25, ""), (0, 25, 25, ""), (0, 120, 120, ""), (0, 1, 0, "short"), (5, 116, 0, f"{d} x {c}"), (6, 60, 60, ""), (2**63 - 1, 25, 25, "")]
    # of the two texts under id 5 that share 60 words either may come first
    assert got in [sorted([*fixed, *two]) for two in ([(5, 60, 0, e), (5, 61, 60, "y")], [(5, 60, 60, ""), (5, 61, 0, e + " y")])]


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "x A b c y a B"), (2, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b"), (8, "C!"), (9, "a, b")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert (got[1].n_hit, got[1].items, got[2].n_hit, got[2].items) == (5, ["7", "8", "9"], 1, ["8"])


def test_items_without_id(spark):
    """As in op1's SQL: all items without id are one more item, without a name."""
    docs = spark.createDataFrame([(1, "x a b y"), (2, "c d"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), (None, "c d"), (9, "C d")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert {k: (r.n_hit, r.n_items, r.items, r.contaminated) for k, r in got.items()} == {1: (2, 1, [], True), 2: (2, 2, ["9"], True), 3: (0, 0, [], False)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'x a b y'), (2, 'c d'), (3, 'none')) t(doc_id, text)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (NULL, 'a b'), (NULL, 'c d'), (9, 'C d')) t(item_id, text)")
    want = con.execute(registry.oracle_sql()["op1_decontaminate"]).fetchall()
    assert sorted(want) == sorted((k, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items())


def test_media(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op5_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest()


def test_interleaving(spark):
    page = "<p>one <b>two</b></p><figure><img src='media:" + "0" * 64 + "' alt=a><figcaption>cap</figcaption></figure>x<img src=far.png alt=far><script>no</script>"
    seq = media.sequence_of(page)
    assert [(i["kind"], i["text"], i["caption"]) for i in seq] == [("text", "one two", None), ("media", None, "cap"), ("text", "x", None), ("media", None, "far")]
    table = spark.createDataFrame([("0" * 64, 5)], "digest string, size int")
    rows = media.resolve(media.interleave(spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string")), table).orderBy("pos").collect()
    assert [r["size"] for r in rows] == [None, 5, None, None]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\</s>[INST]"), (1, 1, "assistant", "é<s>\\"), (1, 1, "assistant", "é<s>\\"), (2, 0, None, None), (None, 3, "x[/INST]", "<<s>s>"), (3, 0, "assistant", "y" * 9_000_000), (3, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_digests(chat_format.format_chat(df)).collect()}
    turns = {}
    for c, _, role, text in rows:
        turns.setdefault(c, []).append((role or "", text or ""))
    for c, t in turns.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(b for a, b in t if a == "assistant").encode()).hexdigest()
    assert chat_format.format_chat(df.where("false")).count() == 0


def test_url_filter_cases(spark):
    urls = [None, "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q", "http://example.org/en/1#f", "http://example.org", "http://xexample.org/es/", "http://b.com/de/1", "http://b.com/fr/1", "http://b.com/fr/1"]
    pages = spark.createDataFrame([(k if k < 9 else 8, u, "h") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect())
    assert got == [(0, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, "example.org/es/", "block"), (4, "example.org/en/1", "block"), (5, None, "allow"), (6, "org/", "allow"), (7, "com/de/", "block"), (8, "com/fr/", "allow"), (8, "com/fr/", "allow")]


def brute_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark, sf):
    docs = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += ["é token: 'abcdef' AKIA" + "Z" * 16 + " " + "a1" * 12, "PASSWORD=12345", "api_key = \"x.y-z_=\"", "ſecret=abcdefgh"]
    assert [[s for s in x if s[1] < 3] for x in secrets.scan_batch([d.encode() for d in docs])] == [brute_secrets(d) for d in docs]


def test_structures():
    def der(tag, data):
        return bytes([tag]) + (bytes([len(data)]) if len(data) < 128 else b"\x82" + len(data).to_bytes(2, "big")) + data

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([9] * 40)) for _ in range(8)))
    token = ".".join(urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"1"}', b"signature"))
    bad = token.replace("eyJhbGci", "eyJhbGxx", 1)
    ssh = secrets.OPENSSH + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub" * 9, b"key" * 9))
    texts = [b64encode(key).decode(), b64encode(key[:-1]).decode(), key.hex(), token, bad, b64encode(ssh).decode(), f"é-----BEGIN RSA PRIVATE KEY-----\n{b64encode(key).decode()}\n-----END RSA PRIVATE KEY-----"]
    found = [{secrets.KINDS[k] for _, k, _ in x} - {"hex"} for x in secrets.scan_batch([t.encode() for t in texts])]
    assert found == [{"der"}, set(), {"der"}, {"jwt"}, set(), {"openssh"}, {"pem", "der"}]


def test_keys_at_any_place():
    def der(tag, data):
        return bytes([tag]) + (bytes([len(data)]) if len(data) < 128 else b"\x82" + len(data).to_bytes(2, "big")) + data

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([9 + j] * 41)) for j in range(8)))
    ssh = secrets.OPENSSH + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub" * 30, b"key" * 40))
    for data, kind in ((key, "der"), (ssh, "openssh")):
        b64 = b64encode(data).decode()
        assert b64.endswith("=") or len(data) % 3 == 0
        lines = [b64[i : i + 64] for i in range(0, len(b64), 64)]
        whole = [b64, "\n".join(lines), "\r\n    ".join(lines), "\\n".join(lines), "\\\\r\\\\n".join(lines), " ".join(lines), '"\n  "'.join(lines), b64.replace("/", "\\/"), b64.rstrip("="), b64.replace("+", "-").replace("/", "_")]
        for body in whole:
            for before, after in (("", ""), ("é PRIVATE_KEY=", " end"), ("/path/", "\n"), ("a-b_", "-----END"), ('{"key":"\\n', '\\n"}'), ("words before\n", "\n\nwords behind"), ("TLSKEY", '"')):
                text = before + body + after
                got = [(secrets.KINDS[k], a, b) for a, k, b in secrets.scan_batch([b"other", text.encode()])[1] if secrets.KINDS[k] not in ("hex", "assign")]
                assert got == [(kind, len(before), len(before) + len(body))], (before, after, body)
        assert not secrets.scan_batch([f"KEY={b64[:-8]}\nwords that follow a key which was cut".encode(), b64[:-8].encode(), "\n".join(lines[:-1]).encode()])[0]
        armour = "-----BEGIN PRIVATE KEY-----\\n" + "\\n".join(lines) + "\\n-----END PRIVATE KEY-----\\n"
        assert "pem" in {secrets.KINDS[k] for _, k, _ in secrets.scan_batch([armour.encode()])[0]}
    assert [(a, b) for a, k, b in secrets.scan_batch([f"KEY=cafe{key.hex()}".encode()])[0] if secrets.KINDS[k] == "der"] == [(8, 8 + 2 * len(key))]
    two = f"A={b64encode(key).decode()} B={b64encode(ssh).decode()}"
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan_batch([two.encode()])[0]] == ["der", "openssh"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token = abcdef0123 end"), (2, None)], "doc_id long, text string")
    assert [r.text for r in secrets.redact(secrets.scan_secrets(df)).orderBy("doc_id").collect()] == ["é [ASSIGN] end", None]
    assert secrets.scan_and_redact(df).orderBy("doc_id").collect() == secrets.redact(secrets.scan_secrets(df)).orderBy("doc_id").collect()


def test_licenses_brute_force(spark):
    grant = licenses.TEMPLATES["MIT-grant"]
    words = grant.split()
    texts = ["x " * 500 + grant + " y" * 300, "z " * 77 + " ".join(words[:70]) + " end", " ".join(words[:30]), "Released under the MIT License. " * 3, "none at all here"]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for t, found in zip(texts, scanner.scan([x.encode() for x in texts])):
        s = scanner.shingles(t.encode())
        assert {x["template"] for x in found} == {n for k, n in enumerate(scanner.names) if scanner.best(s, k)}
    assert scanner.scan([texts[0].encode()])[0][0]["template"] == "MIT-grant"


def test_licenses_every_occurrence():
    grant, notice = licenses.TEMPLATES["MIT-grant"], "Released under the MIT License."
    n, part = len(licenses.WORD.findall(grant.lower().encode())), " ".join(grant.split()[: int(0.9 * len(grant.split()))])
    found = licenses.Scanner(licenses.TEMPLATES).scan([x.encode() for x in (f"{notice} " * 3, f"{grant} x y {grant} {grant}", f"{part} {grant}", f"{grant} {part} z")])
    spans = [[(x["template"], x["start"], x["end"]) for x in f] for f in found]
    assert spans[0] == [("MIT", 5 * k, 5 * k + 5) for k in range(3)]
    assert spans[1] == [("MIT-grant", a, a + n) for a in (0, n + 2, 2 * n + 2)]
    assert [len(x) for x in spans[2:]] == [2, 2] and spans[2][1][2] - spans[2][1][1] == n and spans[3][0][1:] == (0, n)


def test_toxicity_learns_from_document_labels():
    rng = np.random.default_rng(1)
    make = lambda bad: ". ".join(" ".join(f"word{k}" for k in rng.integers(0, 300, 12)) + (" vilestuff" if bad and j == 2 else "") for j in range(6))
    labels = np.arange(300) % 5 == 0
    w = toxicity.train([make(b) for b in labels], labels.astype(int))
    scores = toxicity.Scores(w)
    assert toxicity.score(make(False), scores)[0] < 0.5 and toxicity.score("", scores)[0] == 0
    p, spans = toxicity.score(text := make(True), scores)
    assert p > 0.5 and len(spans) == 1 and "vilestuff" in text[spans[0]["start"] : spans[0]["end"]]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.96


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, docs, sf))
        assert after.columns == docs.columns
        if name == "secrets":
            assert ids(after) == ids(docs)
            assert not any(secrets.scan_batch([r.text.encode()])[0] for r in after.collect())
        if name == "near_dedup":
            gone = ids(docs) - ids(after)
            sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in docs.collect()}
            assert gone and all(any(len(sets[g] & sets[k]) >= 0.8 * len(sets[g] | sets[k]) for k in sets if k != g) for g in gone)
        docs = after
    assert ids(p.STAGES[-1][1](spark, docs, sf)) == ids(docs)
    assert json.dumps([n for n, _ in p.STAGES])


def test_words_of_any_text_without_extracting_each(spark):
    odd = [None, "", " ", ".", "a", ".a", "a.", "AİB K", "\0x\0", "\U0001f600 Z9\U0001d400", "éA-Éa", "\x7fA\x80B", "a\r\n\tb", " A ", "﻿A", "x" * 70_000 + "."]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").select("doc_id", decontaminate.words_of(F.col("text")).alias("w"))
    lower = str.maketrans(decontaminate.ASCII_UPPER, decontaminate.ASCII_LOWER)
    assert {r.doc_id: r.w for r in docs.collect()} == {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(lower)) for k, x in enumerate(odd)}
    # one match result a word took five sixths of the time of words_of
    assert "regexp_extract_all" not in docs._jdf.queryExecution().analyzed().toString()
