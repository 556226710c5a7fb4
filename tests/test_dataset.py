import pytest
from pyspark.sql import functions as F

from quillspan.operators.dataset import Destroyed, Engine
from quillspan.operators.upsert import compare_and_set, put_cells, put_rows
from quillspan.sources.store import TableStore


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def test_bag(engine):
    b = engine.parallelize(["b a", "a", "", "a"])
    assert b.count() == 4 and sorted(b.distinct().collect()) == ["", "a", "b a"]
    assert sorted(b.flat_map(lambda v: F.split(v, " ")).collect()) == ["", "a", "a", "a", "b"]
    assert sorted(b.flat_map(lambda s: None if not s else s.split(), python=True).collect()) == ["a", "a", "a", "b"]
    assert b.filter(lambda v: v != "").count() == 3 and b.take(2) == ["", "a"] and b.take(0) == []
    assert b.map_partitions(lambda vs: (v + "!" for v in vs)).count() == 4
    assert b.fold(F.lit("0"), lambda a, v: F.concat(a, v)).first()[0] == "0aab a"
    assert b.intersection(engine.parallelize(["a", "a", "z"])).collect() == ["a"]
    assert sorted(b.group_by(lambda v: F.substring(v, 1, 1)).collect()) == [("", ""), ("a", "a,a"), ("b", "b a")]
    assert b.sample(0.0).count() == 0
    assert engine.parallelize([]).count() == 0 and engine.parallelize([]).map_partitions(list).count() == 0


def test_pairs(engine):
    b = engine.parallelize(["fruit apple", "fruit banana", "x"])
    p = b.map_to_pair(lambda v: F.nullif(F.substring_index(v, " ", 1), F.lit("x")), lambda v: F.substring_index(v, " ", -1))
    q = engine.parallelize(["cherry", "date", "fig"]).map_to_pair(lambda v: F.lit("fruit"), lambda v: v)
    assert sorted(p.collect()) == [("fruit", "apple"), ("fruit", "banana")]
    assert p.cogroup(q).collect() == [("fruit", "[apple,banana],[cherry,date,fig]")]
    assert p.join(q).count() == 6 and ("fruit", "apple,date") in p.join(q).collect()
    assert p.fold_by_key(F.lit("0"), lambda a, v: F.concat(a, F.lit("+"), v)).collect() == [("fruit", "0+apple+banana")]
    assert p.aggregate_by_key(F.count(F.lit(1))).collect() == [("fruit", 2)]
    assert sorted(p.flat_map(lambda k, v: F.array(k, v)).collect()) == ["apple", "banana", "fruit", "fruit"]
    assert sorted(p.flat_map_to_pair(lambda k, v: F.array(F.struct(v, k))).collect()) == [("apple", "fruit"), ("banana", "fruit")]
    assert sorted(b.flat_map_to_pair(lambda s: [(s[0], s)], python=True).collect())[0] == ("f", "fruit apple")
    assert [r[0] for r in p.shown().collect()] == ["(fruit,apple)", "(fruit,banana)"]
    other = engine.parallelize(["k"]).map_to_pair(lambda v: v, lambda v: v)
    assert sorted(p.cogroup(other).collect()) == [("fruit", "[apple,banana],[]"), ("k", "[],[k]")]


def test_from_table_output_and_destroy(engine, spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    d = engine.from_table(t, F.upper("s"))
    assert d.collect() == ["A"]
    d.destroy()
    with pytest.raises(Destroyed):
        d.count()
    e = Engine(spark)
    assert e.said == "<no output>"
    e.output("a")
    e.output("b")
    assert e.said == "ab"


def test_mutation(spark):
    cells = spark.createDataFrame([("r", "c", "old"), ("r", "d", "keep")], "key string, column string, value string")
    puts = spark.createDataFrame([("r", "c", "first", 1), ("r", "c", "second", 2), ("s", "c", None, 1)], "key string, column string, value string, seq int")
    assert sorted(map(tuple, put_cells(cells, puts).collect()), key=str) == [("r", "c", "second"), ("r", "d", "keep"), ("s", "c", None)]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    assert sorted(map(tuple, put_rows(rows, spark.createDataFrame([(2, "x"), (3, "y")], "key int, v string"), "key").collect())) == [(1, "a"), (2, "x"), (3, "y")]
    change = spark.createDataFrame([(1, "a", "A"), (2, "no", "B"), (9, "a", "C")], "key int, expected string, value string")
    got = sorted((r["key"], r["v"], r["applied"]) for r in compare_and_set(rows, change, "key", "v").collect())
    assert got == [(1, "A", True), (2, "b", False)]


def test_store(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/store")
    assert s.tables() == [] and s.count("t") == 0 and s.scan("t", schema="key string").count() == 0
    s.write("t", spark.createDataFrame([(f"k{i:02}", i) for i in range(25)], "key string, v int"))
    with pytest.raises(FileExistsError):
        s.write("t", spark.createDataFrame([("a", 1)], "key string, v int"))
    assert [r["key"] for r in s.scan("t", "k03", "k06").collect()] == ["k03", "k04", "k05"]
    assert s.get("t", "k07", "v") == 7 and s.get("t", "none", "v") is None and s.get_row("t", "k01")["v"] == 1
    assert s.having("t", spark.createDataFrame([("k01",), ("zz",)], "key string")).collect()[0][0] == "k01"
    rows, after = s.page("t", "k20")
    assert len(rows) == 5 and after is None
    rows, after = s.page("t")
    assert len(rows) == 10 and after == "k10"
    s.put_rows("t", spark.createDataFrame([("k00", 100), ("new", 1)], "key string, v int"))
    assert s.count("t") == 26 and s.get("t", "k00", "v") == 100
    s.write("u", spark.createDataFrame([], "key string, v int"))
    assert not s.rename("t", "u") and not s.rename("no", "x") and s.rename("t", "w")
    assert s.overview() == [("u", 0), ("w", 26)] and s.delete("u") and not s.delete("u") and s.tables() == ["w"]
    with pytest.raises(ValueError):
        s.read("../x")


def test_opaque_functions(spark):
    e = Engine(spark)
    bag = e.parallelize(["apple", "fig", "kiwi", "fig"])
    assert sorted(bag.filter(lambda v: len(v) < 5, python=True).collect()) == ["fig", "fig", "kiwi"]
    pairs = bag.map_to_pair(lambda v: v[0] if v != "kiwi" else None, lambda v: v[1:], python=True)
    assert sorted(pairs.collect()) == [("a", "pple"), ("f", "ig"), ("f", "ig")]
    assert sorted(pairs.fold_by_key("0", lambda acc, v: str(int(acc) + len(v)), python=True).collect()) == [("a", "4"), ("f", "4")]
    assert sorted(pairs.flat_map(lambda k, v: [k, v] if k == "a" else None, python=True).collect()) == ["a", "pple"]
    assert sorted(pairs.flat_map_to_pair(lambda k, v: [(v, k)], python=True).collect()) == [("ig", "f"), ("ig", "f"), ("pple", "a")]
    assert sorted(bag.group_by(lambda v: str(len(v)), python=True).collect()) == [("3", "fig,fig"), ("4", "kiwi"), ("5", "apple")]
    assert bag.fold("", lambda acc, v: acc + v[0], python=True).first()["value"] == "affk"
    assert e.parallelize([]).filter(lambda v: True, python=True).collect() == []


def test_repeated_puts_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (3, "z")], "key int, v string")
    assert sorted(map(tuple, put_rows(old, new, "key").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    changes = spark.createDataFrame([(1, "a", "p", 2), (1, "q", "r", 1), (2, "no", "s", 1)], "key int, expected string, value string, seq long")
    assert sorted((r["key"], r["v"], r["applied"]) for r in compare_and_set(old, changes, "key", "v").collect()) == [(1, "p", True), (2, "b", False)]


def test_a_replacement_that_broke_off_is_mended(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}")
    s.write("t", spark.createDataFrame([("a", 1)], "key string, v int"))
    (tmp_path / "t").rename(tmp_path / "_old-t")
    assert s.count("t") == 1 and s.tables() == ["t"]
    s.write("t", spark.createDataFrame([("a", 2)], "key string, v int"), replace=True)
    assert s.get("t", "a", "v") == 2 and not (tmp_path / "_old-t").exists()
    assert s.overview() == [("t", 1)]
