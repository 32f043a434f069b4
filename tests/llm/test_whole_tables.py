"""Queries without SQL over their whole tables, against brute force or held-out labels."""

import hashlib
import html
import re
import zlib

import pytest
from pyspark.sql import functions as F

from arcloom.llm import licenses, media, secrets, toxicity


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def independent_spans(text):
    """The base spans, by patterns written down here; letters of the assigned name are matched one by one."""
    either = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    spans = []
    for n, (kind, pattern, group, least) in enumerate((("assign", f"""({names})["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        spans += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(spans)


def test_secrets_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = secrets.op9_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        base = independent_spans(texts[r.doc_id])
        said = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if x.split(":")[0] in ("assign", "access", "hex")] == said
        places = [int(x.split(":")[1]) for x in spans]
        assert places == sorted(places)
        found += len(said)
    assert found > 5


def test_encoded_pem_and_many_runs():
    key = bytes([0x30, 0x82, 1, 79, 2, 1, 0]) + b"".join(bytes([2, 40]) + bytes([9] * 40) for _ in range(8))
    key = key[:2] + (len(key) - 4).to_bytes(2, "big") + key[4:]
    from base64 import b64encode

    pem = f"-----BEGIN PRIVATE KEY-----\n{b64encode(key).decode()}\n-----END PRIVATE KEY-----\n"
    for text in (pem, pem.rstrip()):
        twice = b64encode(text.encode()).decode()
        doc = f"é KEY={twice} end"
        got = [(a, b) for a, k, b in secrets.scan_batch([doc.encode()])[0] if secrets.KINDS[k] == "pem"]
        assert got == [(6, 6 + len(twice))]
    assert not secrets.scan_batch([b64encode(pem.replace("PRIVATE KEY", "CERTIFICATE").encode())])[0]
    import time

    text = ("é " + "0123456789abcdef" * 2 + " ") * 30_000
    start = time.perf_counter()
    assert len(secrets.scan_batch([text.encode()])[0]) == 30_000
    assert time.perf_counter() - start < 20


def test_licenses_of_the_query(spark, sf, texts):
    """A template is listed just if a run of 1.25 times its shingles holds 80 % of them; each span holds what it says."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sets = {k: set(grams(words(t))) for k, t in licenses.TEMPLATES.items()}
    planted = {-k - 1: f"{'pad ' * k}{' '.join(t.split()[: max(5, int(0.95 * len(t.split())))])} {'tail ' * 40}{t}" for k, t in enumerate(licenses.TEMPLATES.values())}
    every = texts | planted
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    listed = {r.doc_id: r for r in licenses.op7_licenses(spark, sf).collect()}
    assert len(listed) == len(texts)
    for d, text in every.items():
        # as the operator lower-cases bytes, only A-Z change
        w = re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))
        s = grams(w)
        wanted = set()
        for name, t in sets.items():
            at = [i for i, x in enumerate(s) if x in t]
            wide = max(1, int(1.25 * len(t)))
            if any(len({s[j] for j in at if i <= j < i + wide}) >= 0.8 * len(t) for i in at):
                wanted.add(name)
        assert {x["template"] for x in got[d]} == wanted
        for x in got[d]:
            inside = set(grams(w[x["start"] : x["end"]])) & sets[x["template"]]
            assert abs(len(inside) / len(sets[x["template"]]) - x["containment"]) < 1e-9
        if d in listed:
            assert listed[d].n_licenses == len(got[d])


def test_license_parts(monkeypatch):
    """Texts are cut into parts for retrieval, matches over a cut included."""
    text = ("w " * 37 + " ".join(licenses.TEMPLATES.values()) + " ") * 3
    whole = licenses.Scanner(licenses.TEMPLATES).scan([text.encode(), b"x"])
    monkeypatch.setattr(licenses, "PART", 64)
    assert licenses.Scanner(licenses.TEMPLATES).scan([text.encode(), b"x"]) == whole
    assert len(whole[0]) >= 3 * len(licenses.TEMPLATES)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in toxicity.op10_toxicity(spark, sf).collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(toxic) / len(toxic) >= 0.9
    assert sum(clean) / len(clean) <= 0.01


def test_offending_sentences_are_places_in_the_text():
    """Lower-casing lengthens some letters; spans are of the text as it is."""
    import numpy as np

    make = lambda bad, n: ". ".join(f"plain word{n % 7} here" + (" vilestuff now" if bad and j == 1 else "") for j in range(4))
    labels = np.arange(200) % 4 == 0
    w = toxicity.train([make(b, n) for n, b in enumerate(labels)], labels.astype(int))
    text = "İ" * 12 + " ok. vilestuff now. end"
    p, spans = toxicity.score(text, toxicity.Scores(w))
    assert p > 0.5 and [text[s["start"] : s["end"]] for s in spans] == ["vilestuff now"]
    assert toxicity.score("", toxicity.Scores(w))[0] == 0


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"t{k}") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    seen = []
    kept = toxicity.train
    toxicity.train = lambda d, y: (seen.append(len(d)), kept(d, y))[1]
    try:
        a = toxicity.fit(docs, labels, sample=20)
        b = toxicity.fit(docs, labels, sample=20)
    finally:
        toxicity.train = kept
    assert (a == b).all()


def test_real_pages(spark, sf):
    """All pages: texts in order, without scripts, styles and titles, by a reader of its own; their urls resolve to nothing."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r["items"] for r in media.interleave(pages).collect()}
    for r in pages.collect():
        page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|title)[^>]*>.*?</\1>", "", r.html or "")
        text = html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", " ", page))
        said = "".join("".join((i["text"] or "").split()) for i in got[r.page_id] if i["kind"] == "text")
        assert said == "".join(text.split())
        assert [i["pos"] for i in got[r.page_id]] == list(range(len(got[r.page_id])))


def test_payloads_are_stored_once(spark):
    docs = spark.createDataFrame([(k, "same" if k % 2 else f"t{k}") for k in range(20)] + [(None, "same"), (None, None), (3, ""), (None, "x")], "doc_id long, text string")
    stored = media.store_payloads(docs).collect()
    assert sorted(r.n for r in stored) == sorted([11, 2] + [1] * 11)
    pages = media.pages_of(docs, media.stored(media.store_payloads(docs)))
    assert pages.count() == docs.count()
    rows = media.resolve(media.interleave(pages), media.stored(media.read_media(media.stored(media.store_payloads(docs))))).where("kind = 'media'")
    assert rows.count() == docs.count() and rows.where("payload_bytes IS NULL OR caption IS NULL").count() == 0


@pytest.mark.parametrize("hot", [1, 50_000])
def test_media_hot_and_odd_rows(spark, monkeypatch, hot):
    from arcloom import storage

    monkeypatch.setattr(storage, "HOT", hot)
    monkeypatch.setattr(storage, "MOST_HOT", 10**9)
    monkeypatch.setattr(media, "BROADCAST_KEYS", hot)
    page = "<figure><img src='media:" + "a" * 64 + "'><figcaption>c<p>d</figure><![foo[bar]]><p>t<img src='x.png'><figcaption>lost"
    seq = media.interleave(spark.createDataFrame([(1, page, 5), (2, None, 6), (3, page, 7), (4, "", 8)], "id long, html string, size int"))
    table = spark.createDataFrame([("a" * 64, 9), ("b" * 64, 1)], "digest string, size int")
    got = sorted(((r.id, r.pos, r.kind, r.text, r.caption, r["size"]) for r in media.resolve(seq, table).collect()), key=repr)
    one = [(0, "media", None, "c d", 9), (1, "text", "t", None, None), (2, "media", None, None, None), (3, "text", "lost", None, None)]
    assert got == sorted([(k, *x) for k in (1, 3) for x in one], key=repr)
    empty = seq.where("false")
    assert media.resolve(empty, table).count() == 0


def test_frequent_words(spark):
    from arcloom.llm import bpe

    docs = spark.createDataFrame([(" ".join(f"w{chr(97 + k)}" for k in range(26) for _ in range(2 ** (k // 3))),), (None,)], "text string")
    words = bpe.frequent_words(docs, most=9, least=2)
    assert set(words) == {f"w{chr(97 + k)}" for k in range(18, 26)}
    assert bpe.frequent_words(docs.where("false")) == [] and bpe.frequent_words(docs, most=1, least=2) == []


def test_pipeline_stages_by_brute_force(spark, sf):
    """near_dedup keeps one of each group and decontaminate what its SQL doesn't mark, both ways; the ids decode."""
    import duckdb

    import corpus_pipeline as p
    from arcloom.llm import decontaminate
    from test_paths import brute_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for (d, _), g in zip(rows, brute_groups(rows, 80)):
        first[g] = min(d, first.get(g, d))
    after = p.stored(stages["near_dedup"](spark, docs, sf))
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{after._stored_at}/*.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf}/benchmark.parquet')")
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.SQL['op1_decontaminate']}) WHERE NOT contaminated").fetchall()}
    assert {r.doc_id for r in stages["decontaminate"](spark, after, sf).collect()} == clean
    last = stages["bpe"](spark, after, sf)
    assert last.where(~F.col("round_trip")).count() == 0 and last.count() == after.count()


def test_run_decides_on_rows_without_id(spark, tmp_path):
    """Contaminated and near-duplicate rows without doc_id go; of equal texts without one, one stays."""
    import corpus_pipeline as p

    passage = " ".join(f"passage{k}" for k in range(14))
    near = [f"near{k}" for k in range(60)]
    rows = [(1, " ".join(near)), (None, " ".join([*near[:59], "x"])), (None, f"lead {passage} end"), (None, "alone here"), (None, "alone here"), (None, None), (2, f"lead {passage} tail"), (2, "clean")]
    for name, data, schema in (("documents", rows, "doc_id long, text string"), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [("i1", passage)], "item_id string, text string")):
        df = spark.createDataFrame(data, schema)
        if name == "documents":
            df = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(((r.doc_id, r.n_tokens > 0) for r in p.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, True), (None, True), (None, False), (2, True)], key=repr)
