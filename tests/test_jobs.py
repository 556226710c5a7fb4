import pytest
from pyspark.sql import functions as F

from quillspan.plans import jobs as J


def test_pagerank_equals_iteration(spark):
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "off"), ("c", "a"), ("d", "d"), ("x", "a")]
    nodes = ["a", "b", "c", "d", "sink"]
    r = dict.fromkeys(nodes, 1.0)
    for _ in range(7):
        r = {n: 0.15 + sum(0.85 * r[s] / sum(e[0] == s for e in edges) for s, t in edges if t == n and s in r) for n in nodes}
    e, n = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in [*nodes, "a"]], "id string")
    got = {x["id"]: x["rank"] for x in J.pagerank(e, n, rounds=7).collect()}
    assert got == pytest.approx(r)
    done = J.pagerank(e, n, epsilon=1e-6, share=1.0)
    assert done.where(F.abs(F.col("rank") - F.col("prev")) > 1e-6).count() == 0
    assert J.pagerank(e.limit(0), n.limit(0)).count() == 0


def test_terms_and_idf(spark):
    docs = spark.createDataFrame([("d1", "<b>The</b> cat, the CATS"), ("d2", None), ("d3", "")], "doc string, text string")
    tf = {(r["doc"], r["term"]): r["tf"] for r in J.term_frequency(docs, "doc", "text").collect()}
    assert tf == pytest.approx({("d1", "the"): 0.4, ("d1", "cat"): 0.2, ("d1", "cats"): 0.2})
    stems = {(r["doc"], r["term"]): r["tf"] for r in J.term_frequency(docs, "doc", "text", stems=True).collect()}
    assert stems == pytest.approx({("d1", "the"): 0.4, ("d1", "cat"): 0.4})


def test_index(spark):
    pairs = spark.createDataFrame([("hot", f"u{i:03}") for i in range(60)] + [("one", "u")], "term string, url string")
    rows = J.packed_index(pairs, most=20).collect()
    hot = [r["urls"].split(",") for r in rows if r["term"] == "hot"]
    assert len(hot) > 2 and sorted(u for x in hot for u in x) == [f"u{i:03}" for i in range(60)]
    assert [(r["shard"], r["urls"]) for r in rows if r["term"] == "one"] == [(0, "u")]
    a = spark.createDataFrame([("x", "1,2"), ("y", "3"), ("e", "")], "term string, urls string")
    b = spark.createDataFrame([("x", "2,4"), ("z", "5"), ("y", ""), ("e", "9")], "term string, urls string")
    assert {tuple(r) for r in J.merge_index(a, b).collect()} == {("x", "1,2,2,4"), ("y", "3"), ("z", "5"), ("e", "9")}
    assert {tuple(r) for r in J.merge_index(a, b, once=True).where("term = 'x'").collect()} == {("x", "1,2,4")}
    lex = J.lexicon(spark.createDataFrame([(" Cats ",), ("the",), ("",), (None,), ("cat",)], "value string"))
    assert [r["term"] for r in lex.collect()] == ["cat"]
    assert {tuple(r) for r in J.seed_index(lex, a).where("urls = ''").collect()} == {("e", ""), ("cat", "")}


def test_search(spark):
    words = spark.createDataFrame([("a",), ("b",)], "term string")
    tf = spark.createDataFrame([("d1", "a", 0.5), ("d2", "a", 0.1), ("d2", "b", None), ("d3", "c", 1.0)], "doc string, term string, tf double")
    idf = spark.createDataFrame([("a", 2.0)], "term string, idf double")
    ranks = spark.createDataFrame([("d2", 4.0)], "id string, rank double")
    best = J.search(words, tf, idf, ranks, n=5)
    assert [(r["doc"], round(r["score"], 6)) for r in best.collect()] == [("d1", 0.95), ("d2", 0.59)]
    pages = spark.createDataFrame([("d1", "http://x", 'p "q"<i>')], "page_key string, url string, page string")
    assert J.as_json(J.with_snippets(best, pages)).first()[0] == '[{"url":"http://x","preview":"p \\"q\\""},{"url":"","preview":""}]'


def test_admit(spark):
    found = spark.createDataFrame([(f"http://h.test:80/p{i}",) for i in range(6)] + [("http://h.test:80/no/x",), ("http://h.test:80/de/x",), ("http://h.test:80/a/b/c/d",), ("http://g.test:80/x.pdf",), ("http://g.test:80/yes.pdf",), (None,), ("http://h.test:80/p0",)], "url string")
    seen = spark.createDataFrame([("http://h.test:80/p5",)], "url string")
    hosts = spark.createDataFrame([("h.test", [("disallow", "/no")], 1), ("g.test", [("allow", "/yes")], None)], "host string, rules array<struct<rule_type:string,prefix:string>>, url_count int")
    got = {r["url"] for r in J.admit(found, seen, hosts, cap=4, codes=["de"], patterns=[r".*\.pdf$"]).collect()}
    assert got == {"http://h.test:80/p0", "http://h.test:80/p1", "http://h.test:80/p2", "http://g.test:80/yes.pdf"}


def crawl(spark):
    rows = [("k1", "http://a.test:80/", "a.test", "<a href='/b'>B</a> Running dogs", 1), ("k1", "http://a.test:80/", "a.test", "<a href=/c#x>C</a> cats <a href='/b'>B</a> cat", 2), ("k2", "http://a.test:80/b", "a.test", "<a href='/'>home</a> a runner runs", 1), ("k2", "http://a.test:80/b", "a.test", "<a href='/'>home</a> a runner runs", 1), ("k3", "http://a.test:80/c", "a.test", "", 1)]
    return spark.createDataFrame(rows, "page_key string, url string, host string, page string, crawl_id long")


@pytest.mark.parametrize("make", [lambda c: J.page_term_frequency(c), lambda c: J.page_postings(c), lambda c: J.latest_pages(c, links=F.col("page").substr(1, 3)), lambda c: J.crawl_round(c, c.select("url").limit(0), c.sparkSession.createDataFrame([], "host string, rules array<struct<rule_type:string,prefix:string>>, url_count int"))])
def test_no_page_is_moved(spark, tmp_path, make):
    crawl(spark).write.parquet(f"{tmp_path}/c")
    df = make(spark.read.parquet(f"{tmp_path}/c"))
    plan = df._jdf.queryExecution().executedPlan()
    seen = []

    def walk(node):
        if "Exchange" in node.nodeName():
            out = node.child().output()
            seen.extend(out.apply(i).name() for i in range(out.size()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.initialPlan())

    walk(plan)
    assert seen and "page" not in seen


def test_pages_by_their_last_fetch(spark):
    tf = {(r["doc"], r["term"]): r["tf"] for r in J.page_term_frequency(crawl(spark)).collect()}
    assert {t for d, t in tf if d == "k1"} == {"c", "cats", "b", "cat"} and tf["k2", "runner"] == pytest.approx(1 / 5)
    assert {tuple(r) for r in J.page_postings(crawl(spark), stems=True).where("term in ('cat', 'run', 'runner')").collect()} == {("cat", "http://a.test:80/"), ("runner", "http://a.test:80/b"), ("run", "http://a.test:80/b")}
    lex = spark.createDataFrame([("cat",), ("cat",)], "term string")
    assert [tuple(r) for r in J.page_postings(crawl(spark), lex, stems=True).collect()] == [("cat", "http://a.test:80/")]


def test_search_from_the_index(spark):
    pairs = J.page_postings(crawl(spark), stems=True)
    words = J.query_terms(spark, "Cats, running?", stems=True)
    assert {r["term"] for r in words.collect()} == {"cat", "run"}
    from quillspan.functions.hashing import row_key

    keyed = crawl(spark).withColumn("page_key", row_key(F.col("url")))
    tf, idf = J.page_term_frequency(keyed, stems=True), J.index_idf(pairs)
    assert J.index_documents(pairs) == 2 and {r["term"]: round(r["idf"], 9) for r in idf.where("term in ('cat', 'home')").collect()} == {"cat": 0.0, "home": 0.0}
    ranks = keyed.where("url like '%/b'").select(F.col("page_key").alias("id"), F.lit(3.0).alias("rank")).distinct()
    best = [(r["url"], round(r["score"], 9)) for r in J.search_index(words, pairs, tf, idf, ranks).collect()]
    # A posting without a frequency counts with its rank alone.
    assert best == [("http://a.test:80/b", 0.15), ("http://a.test:80/", 0.0)]
    assert [(r["url"], round(r["score"], 9)) for r in J.search_index(words, pairs, tf.limit(0), idf.limit(0), ranks).collect()] == best


def test_ranks_that_do_not_converge_raise(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    with pytest.raises(RuntimeError):
        J.pagerank(e, e.select(F.col("src").alias("id")), epsilon=1e-12, most_rounds=2)


def test_indexes_are_merged_by_shard_and_extended(spark):
    a = spark.createDataFrame([("x", 0, "1"), ("x", 1, "2")], "term string, shard int, urls string")
    b = spark.createDataFrame([("x", 1, "3"), ("y", 0, "4")], "term string, shard int, urls string")
    assert {tuple(r) for r in J.merge_index(a, b).collect()} == {("x", 0, "1"), ("x", 1, "2,3"), ("y", 0, "4")}
    more = J.extend_index(a, spark.createDataFrame([("x", "2"), ("x", "5"), ("z", "6")], "term string, url string"))
    assert {tuple(r) for r in more.collect()} == {("x", 0, "1,2,5"), ("z", 0, "6")}


def test_a_crawl_goes_on_until_no_url_is_left(spark):
    web = {"/": "<a href='/b'>x</a> <a href=/c#top>y</a>", "/b": "<a href='/'>x</a>", "/c": "<A HREF=\"/d\">z</a>", "/d": "<a href='/no/e'>z</a>", "/no/e": "", "/apart": ""}
    pages = spark.createDataFrame([(f"k{p}", f"http://a.test:80{p}", "a.test", t, 1) for p, t in web.items()], "page_key string, url string, host string, page string, crawl_id long")
    seeds = spark.createDataFrame([("http://a.test:80/",), (None,)], "url string")
    hosts = spark.createDataFrame([("a.test", [("disallow", "/no")], 0)], "host string, rules array<struct<rule_type:string,prefix:string>>, url_count int")
    fetch = lambda queue: pages.join(queue.select("url"), "url", "left_semi")
    assert {r["url"][16:] for r in J.crawl_all(fetch, seeds, hosts).collect()} == {"/", "/b", "/c", "/d"}
    assert J.crawl_all(fetch, seeds, hosts, cap=2).count() == 2
    assert J.crawl_all(fetch, seeds.limit(0), hosts).count() == 0
