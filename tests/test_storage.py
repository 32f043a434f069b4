import random

import pytest
from pyspark.sql import functions as F

from arcloom import storage
from arcloom.operators.components import components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted(spark, how):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaabcdeg"), k) for k in range(300)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    groups = df.where("k <> 'g'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = sorted(df.join(groups.drop("n"), "k", how).collect(), key=repr)
    for hot in (1, 20, 10_000, None):
        got = storage.join_counted(df, groups, ["k"], "n", hot, how)
        assert got.columns == ["k", "v", "top"]
        assert sorted(got.collect(), key=repr) == want


def test_number_of_hot_keys_is_bounded():
    assert storage.hot_from(10) is None
    assert 10**12 // storage.hot_from(10**12) <= storage.MOST_HOT


def test_stored_and_discarded(spark):
    t = storage.stored(spark.range(5))
    assert t.count() == 5
    storage.discard(t)
    with pytest.raises(Exception):
        storage.stored(spark.read.schema("id long").parquet(t._stored_at)).count()


@pytest.mark.parametrize("hot", [1, 50_000])
def test_components_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(storage, "HOT", hot)
    rng = random.Random(hot)
    edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(500, k) for k in range(501, 520)] + [(k, k + 1) for k in range(600, 620)] + [(7, 7), (None, 3)]
    above = {}

    def top(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            above[y] = x
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == {n: top(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
