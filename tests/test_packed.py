import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators.packed import explode_packed, once_per_key, split_packed

CASES = [
    (None, None),
    ("", []),
    (" ", []),
    ("[]", []),
    (",", []),
    ("null,http://a.test:80/x", ["http://a.test:80/x"]),
    ("http://a.test:80/t/b,c/1;;http://a.test:80/p;v=1;s=q/2|http://a.test:80/c|d|3", ["http://a.test:80/t/b,c/1", "http://a.test:80/p;v=1;s=q/2", "http://a.test:80/c|d|3"]),
    ('"http://a.test:80/f?q=""x y""&n=1" ,"http://b.test:80/g?to=z,http://c.test/x"', ['http://a.test:80/f?q="x y"&n=1', "http://b.test:80/g?to=z,http://c.test/x"]),
    (r'["http://a.test:80/f?q=\"x y\"&n=1","http://b.test:80/"]', ['http://a.test:80/f?q="x y"&n=1', "http://b.test:80/"]),
    (r"['http://a.test:80/it\'s', 'http://b.test:80/']", ["http://a.test:80/it's", "http://b.test:80/"]),
    ("http://a.test:80/it's/1, http://b.test:80/it's/2", ["http://a.test:80/it's/1", "http://b.test:80/it's/2"]),
    ("http://a.test:80/x\n\n\nhttp://a.test:80/x\thttps://b.test:443/y,,", ["http://a.test:80/x", "http://a.test:80/x", "https://b.test:443/y"]),
    ("[http://a.test:80/x, http://b.test:80/y]", ["http://a.test:80/x", "http://b.test:80/y"]),
    ("ftp://a.test/x,/rooted,http://b.test:80/y", ["http://b.test:80/y"]),
    ('"http://a.test:80/never closed', ["http://a.test:80/never"]),
    ("0,\"http://a.test:80/\"", ["http://a.test:80/"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", split_packed(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_round_trip_of_packings(spark):
    r = random.Random(8)
    shapes = ["http://h{}.test:80/w/{}", "https://h{}.test:443/t/a,b/{}", "http://h{}.test:80/p;v=1;s=x/{}", "http://h{}.test:80/a|b|{}", "http://h{}.test:80/it's/{}", 'http://h{}.test:80/f?q="x y"&n={}', "http://h{}.test:80/g?to=z,http://e.test/x&n={}"]
    rows, want = [], {}
    for i in range(400):
        values = [r.choice(shapes).format(r.randrange(9), r.randrange(99)) for _ in range(r.randrange(1, 8))]
        quote_all = r.random() < 0.3 or False
        delimiter = r.choice([",", ", ", ";", "|", " | ", "\t", "\n", " ;", ",,"])
        out = []
        for v in values:
            if quote_all or '"' in v or "http://e" in v or r.random() < 0.2:
                v = '"' + (v.replace('"', '""') if r.random() < 0.5 else v.replace('"', '\\"')) + '"'
            out.append(v)
        text = delimiter.join(out)
        rows.append((i, r.choice(["", " ", ",", "null,"]) + text + r.choice(["", ",", " ", ";;"]), "x", 0))
        want[i] = list(enumerate(values))
    df = spark.createDataFrame(rows, "id int, t string, value string, pos int")
    got = {}
    for x in explode_packed(df, "t").collect():
        got.setdefault(x["id"], []).append((x["pos"], x["value"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_long_texts(spark):
    values = [f"http://h.test:80/t/a,b/{i}" for i in range(20000)]
    text = ",".join(values) + ',"' + "y" * 200000 + '"'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(split_packed(F.col("t")))).first()[0] == 20000


def test_once_per_key_and_empty(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (None, "z", 3), (2, None, 4)], "k int, v string, w int")
    assert sorted(map(tuple, once_per_key(df, "k").collect())) == [(1, "a", 2), (2, None, 4)]
    assert explode_packed(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("text", ["'" * 5000, '"' * 5001, "[" * 300, "\\" * 4000, ",;| \n" * 2000])
def test_odd_texts_do_not_crash(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(split_packed(F.col("t"))).first()[0] == []
