import random
from collections import Counter

from quillspan.operators.joins import join_small
from quillspan.operators.skew import count_rows, heavy_keys, max_of, min_of, salted_aggregate, sum_of


def rows():
    r = random.Random(3)
    keys = ["hot"] * 3000 + ["warm"] * 400 + [f"k{i % 500}" for i in range(2000)] + [None] * 50 + [""] * 20
    return [(i, k, r.randrange(100), "x") for i, k in enumerate(keys)] + [(0, "hot", 5, "x")]


def test_equals_a_plain_aggregate(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, k string, v int, __salt string").repartition(5)
    aggs = {"n": count_rows(), "total": sum_of("v"), "least": min_of("v"), "most": max_of("v")}
    got = {r["k"]: (r["n"], r["total"], r["least"], r["most"]) for r in salted_aggregate(df, ["k"], aggs, ["id"]).collect()}
    want = {k: (c, sum(x[2] for x in data if x[1] == k), min(x[2] for x in data if x[1] == k), max(x[2] for x in data if x[1] == k)) for k, c in Counter(x[1] for x in data).items()}
    assert got == want
    assert {r["k"]: r["n"] for r in salted_aggregate(df, ["k"], {"n": count_rows()}, [], salts=3).collect()} == {k: v[0] for k, v in want.items()}


def test_only_heavy_keys_are_salted(spark):
    df = spark.createDataFrame(rows(), "id long, k string, v int, x string")
    assert len(heavy_keys(df, ["k"], share=0.05)) == 2
    heavy = heavy_keys(df, ["k"], share=0.05)
    staged = salted_aggregate(df, ["k"], {"n": count_rows()}, ["id"], salts=8, heavy=heavy)
    assert staged.count() == df.select("k").distinct().count()


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k string, v int")
    assert heavy_keys(df, ["k"]) == []
    assert salted_aggregate(df, ["k"], {"n": count_rows()}, ["id"]).count() == 0


def test_join_small_either_way(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), ("none", 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        for limit in (100, 1):
            got = join_small(left, right, ["k"], how, spread=["id"], limit=limit)
            assert sorted(map(str, got.collect())) == want, (how, limit)
