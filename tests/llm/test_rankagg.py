import random

import pytest

from quillspan.llm.rankagg import rank_aggregate


def brute(rows, k=2):
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        n = len(mine)
        pos = {}
        for j in (2, 3):
            for p, r in enumerate(sorted(mine, key=lambda r: (r[j] is None, -(r[j] or 0), r[1])), 1):
                pos[r[1], j] = p
        got = []
        for r in mine:
            a = sorted(1.0 if r[j] is None else pos[r[1], j] / n for j in (2, 3))
            sig = min(1.0, 2 * min(1 - (1 - a[0]) ** 2, a[1] ** 2))
            got.append((sig, pos[r[1], 2] + pos[r[1], 3], r[1]))
        for p, (sig, _, i) in enumerate(sorted((round(s, 12), t, i) for s, t, i in got), 1):
            out[g, i] = (n, pos[i, 2], pos[i, 3], round(sig, 9), p)
    return out


@pytest.mark.parametrize("group_rows", [10_000, 40])
def test_equals_brute_force(spark, group_rows):
    r = random.Random(1)
    rows = [(g, f"d{i:04}", r.choice([None, round(r.random(), 2)]), r.choice([None, float(r.randrange(1000))])) for g, n in (("hot", 400), ("a", 30), ("b", 7), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame([(*x, 0) for x in rows] + [(None, "d", 1.0, 1.0, 0), ("a", None, 1.0, 1.0, 0)], "g string, item string, s double, t double, n int")
    got = {(x["g"], x["item"]): (x["n"], x["pos_s"], x["pos_t"], round(x["significance"], 9), x["position"]) for x in rank_aggregate(df, "g", "item", ["s", "t"], group_rows=group_rows).collect()}
    want = brute(rows)
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    assert sorted(v[4] for k, v in got.items() if k[0] == "hot") == list(range(1, 401))
    order = sorted((k for k in got if k[0] == "hot"), key=lambda k: got[k][4])
    sig = [got[k][3] for k in order]
    assert sig == sorted(sig)


def test_ties_and_empty(spark):
    df = spark.createDataFrame([("q", f"p{i:03}", 1.0, None) for i in range(200)], "g string, item string, s double, t double")
    got = {x["item"]: x["pos_s"] for x in rank_aggregate(df, "g", "item", ["s", "t"], group_rows=30).collect()}
    assert got == {f"p{i:03}": i + 1 for i in range(200)}
    assert rank_aggregate(df.limit(0), "g", "item", ["s", "t"]).count() == 0
