import pytest

import corpus_pipeline as p

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, kept string, row string"
CLASH = ("s", "p", "k", "r")
PASSAGE = " ".join(f"passage{k}" for k in range(14))
LONG = " ".join(f"w{k % 5000}" for k in range(200_000))
ROWS = [
    (1, None, None, None, None, *CLASH),
    (2, "", "en", "a", 0, *CLASH),
    (None, f"no id {PASSAGE}", "en", "a", 5, *CLASH),
    (3, " ".join(f"near{k}" for k in range(40)), "en", None, 9, *CLASH),
    (4, " ".join(f"near{k}" for k in range(39)), "en", "a", 9, None, None, None, None),
    (5, f"lead {PASSAGE} end", "en", "a", 9, *CLASH),
    (6, "key token = abcdef0123 end", "en", "a", 26, *CLASH),
    (7, "twice", "en", "a", 5, *CLASH),
    (7, "twice", "en", "a", 5, *CLASH),
    (8, LONG, "en", "a", len(LONG), *CLASH),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables beside the documents: no labels, an item with text and others without."""
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("i1", PASSAGE), ("i2", None), (None, "lead"), ("i3", "")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


GONE = {"toxicity": [], "near_dedup": [4], "decontaminate": [5], "secrets": []}


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, stage", p.STAGES[:-1])
def test_stage_on_odd_rows(spark, folder, name, stage):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    after = stage(spark, docs, folder)
    want = [r for r in ROWS if r[0] not in GONE[name]]
    if name == "secrets":
        want = [(*r[:1], "key [ASSIGN] end", *r[2:4], 16, *r[5:]) if r[0] == 6 else r for r in want]
    assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
    assert as_rows(after) == sorted(want, key=repr)
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_decontaminate_decides_by_row(spark, folder):
    """A clean text stays where another one under its doc_id goes."""
    docs = spark.createDataFrame([(1, f"a {PASSAGE}"), (1, "clean"), (2, None), (2, f"b {PASSAGE}"), (3, "clean")], "doc_id long, text string")
    assert as_rows(p.drop_contaminated(spark, docs, folder)) == as_rows(docs.where("text = 'clean' OR text IS NULL"))


def test_last_stage_on_odd_rows(spark, folder):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    got = p.encode(spark, docs, folder).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert p.encode(spark, docs.where("false"), folder).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    """Decisions take effect: those with an offending sentence go, all others stay."""
    rows = [(k, f"plain words number{k % 17} here. " + ("some vilestuff there. " if k % 4 == 0 else "more plain words. "), "en", "a", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in p.drop_toxic(spark, docs, str(tmp_path)).collect()} == {k for k in range(400) if k % 4}
