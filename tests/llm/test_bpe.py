import hashlib
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from arcloom.llm import bpe

TEXTS = ["", None, " ", "Hello  world\n\n  it's we'll 12345 <|endoftext|> x<|endoftext|>", "aaaaaaaaaaaa" * 40, "é" * 500, "日本語 текст 🎉🎉", "\t tabs \r\n", "x" * 100_000, "the the The the\nthe", "a1b2c3!!??..", "don't DON'T"]


def test_equals_library(spark):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string")
    lexicon = bpe.compile_lexicon(spark, bpe.default_vocabulary(), ["the", "The", "Hello", "world", "tabs"])
    back = bpe.decode_ids(bpe.encode_texts(docs, lexicon), lexicon).collect()
    assert len(back) == len(TEXTS) + 1
    for r in back:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.text == t.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_numbers_words():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"a", b" tops", b"stop", b"stops"})
    edges, final = bpe.minimal_automaton(words)
    arrays = bpe.pack(edges, final)
    for n, w in enumerate(words):
        s, k = 0, 0
        for c in w:
            slot = arrays["base"][s] + c
            assert arrays["check"][slot] == s
            s, k = arrays["target"][slot], k + arrays["skip"][slot]
        assert arrays["final"][s] and k == n


def test_empty_table(spark):
    lexicon = bpe.compile_lexicon(spark, bpe.default_vocabulary(), [])
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), lexicon).count() == 0


def test_pipeline_encodes_and_decodes_in_one_worker(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.encode(spark, docs, sf)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    lexicon = bpe.compile_lexicon(spark, bpe.default_vocabulary(), bpe.frequent_words(docs))
    chained = {r.doc_id: r.ids for r in bpe.encode_texts(docs.select("doc_id", "text"), lexicon).collect()}
    assert {r.doc_id: r.ids for r in out.collect()} == chained and all(r.round_trip for r in out.collect())


def test_decoding_takes_few_ids_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    sizes = []

    class Lexicon:
        def decode(self, ids):
            sizes.append(len(ids))
            return bytes(ids.astype(np.uint8)), np.arange(1, len(ids) + 1)

    monkeypatch.setattr(bpe, "Lexicon", lambda path: Lexicon())
    monkeypatch.setattr(bpe, "SparkFiles", type("S", (), {"get": staticmethod(lambda x: x)}))
    rows = [[97] * k for k in (3, 0, 2, 9, 1, 0, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, bpe.IDS)], ["ids"]).slice(1)
    out = list(bpe.decode_batches(iter([batch]), "", 5))
    assert [x for b in out for x in b.column("text").to_pylist()] == ["a" * len(r) for r in rows[1:]]
    assert [x for b in out for x in b.column("ids").to_pylist()] == rows[1:] and sizes == [2, 9, 5]


PEAK = """
import os, random, re
import pyarrow as pa
from arcloom.llm import bpe, common

class Spark:
    class sparkContext:
        addFile = staticmethod(lambda path: None)

def now(what):
    return int(re.search(what + r":\\s+(\\d+) kB", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(5)
known = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
path = bpe.compile_lexicon(Spark, bpe.default_vocabulary(), known)
bpe.SparkFiles.get = lambda name: os.path.join(bpe.SERVED[-1].name, name)
rows = [" ".join(rng.choice(known) if rng.random() < 0.8 else hex(rng.getrandbits(40)) for _ in range(520)) for _ in range(5000)]
batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])
size, rows = batch.nbytes / 1e6, None
common.give_back()
before, done = now("VmRSS"), 0
open("/proc/self/clear_refs", "w").write("5")  # the peak starts anew
for out in bpe.decode_batches(bpe.encode_batches(iter([batch]), path), path):
    done += out.num_rows
print(done, size, now("VmHWM") - before, now("VmRSS") - before)
"""


def test_worker_stays_small_on_a_large_batch():
    """A batch of 21 MB: with all its texts at once, in blocks of 2 MB, the worker grew by 140 MB and kept 55."""
    said = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(Path(bpe.__file__).parents[2]), "OMP_NUM_THREADS": "1"}).stdout
    done, size, peak, after = map(float, said.split())
    assert done == 5000 and size > 15
    assert peak < 110 and after < 35, said
