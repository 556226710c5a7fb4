from quillspan.functions.hashing import row_key
from quillspan.sources.files import load_objects, once_per_prefix, read_words, write_words


def test_words(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" b \n\na\nb\n")
    words = read_words(spark, f"file://{tmp_path}/w.txt")
    assert sorted(r["term"] for r in words.collect()) == ["a", "b"]
    write_words(words, f"file://{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/out").orderBy("value").collect()] == ["a", "b"]


def test_objects(spark, tmp_path):
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "a").write_text("one é")
    (tmp_path / "p" / "q" / "b").write_text("two")
    (tmp_path / "p" / "c").write_text("")
    base = load_objects(spark, f"file://{tmp_path}/p")
    assert base.count() == 2  # the file source lists no empty files
    paths = {r["page"]: r["url"] for r in base.collect()}
    manifest = spark.createDataFrame([(paths["one é"], "http://a"), (paths["two"], "http://a")], "path string, url string")
    got = load_objects(spark, f"file://{tmp_path}/p", manifest)
    rows = {r["url"]: (r["page"], r["length"]) for r in got.collect()}
    assert rows["http://a"] in (("one é", 5), ("two", 3)) and len(rows) == 1
    from pyspark.sql import functions as F

    assert got.where(row_key(F.col("url")) != F.col("key")).count() == 0


def test_once_per_prefix(spark):
    df = spark.createDataFrame([("abcdefghX", 1), ("abcdefghA", 2), ("b", 3), (None, 4)], "s string, n int")
    assert sorted(map(str, once_per_prefix(df, "s").collect())) == sorted(map(str, df.where("n > 1").collect()))
