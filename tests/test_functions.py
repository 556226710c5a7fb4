import hashlib

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.hashing import decode_key, encode_key, row_key
from quillspan.functions.stem import porter, with_stems


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def plain_key(s):
    out = ""
    for u in hashlib.sha1(s.encode()).digest():
        x = 255 if u == 0 else u - 1 if u > 127 else u
        out += chr(97 + x % 26) + "acegikmoqs"[x // 26]
    return out


@pytest.mark.parametrize("s", ["", "a", "http://a.test:80/é", "x" * 5000])
def test_row_key(spark, s):
    assert one(spark, s, row_key) == plain_key(s)


def test_row_key_of_null_and_key_forms(spark):
    assert one(spark, None, row_key) == ""
    assert one(spark, "a-B/9_é", encode_key) == "a-B_2f9_5f_e9"
    assert one(spark, "a-B_2f9_5f", decode_key) == "a-B/9_"


# Words of the examples published with the algorithm.
STEMS = dict(x.split(":") for x in "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll by:by a:a".split())


@pytest.mark.parametrize("word,stem", STEMS.items())
def test_porter(word, stem):
    assert porter(word) == stem


def test_with_stems(spark):
    df = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, None), (4, "")], "i int, w string")
    assert {(r["i"], r["stem"]) for r in with_stems(df, "w").collect()} == {(1, "cat"), (2, "cat"), (3, None), (4, "")}


def test_words_are_the_tokens_without_empties(spark):
    texts = ["<p>It’s A\n<b\n>B-c 9</p> ", " \n", "", "a", " a b", "é<i>a", "<a", "x>y<z>"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", T.tokens(F.col("x")).alias("t"), T.words(F.col("x")).alias("w"), T.token_count(T.plain(F.col("x")), T.words(F.col("x"))).alias("n")).collect():
        assert r["w"] == [t for t in r["t"] if t] and r["n"] == len(r["t"]), r


def test_text(spark):
    assert one(spark, "<p>It’s A\n<b\n>B-c 9</p> ", T.tokens) == ["", "it", "s", "a", "b", "b", "c", "9"]
    assert one(spark, " \n", T.words) == [] and one(spark, None, T.words) is None
    assert one(spark, "What's the (Mandate), mandate?", T.query_words) == ["what's", "the", "mandate"]
    assert one(spark, "<a>x</a>\n " + "y" * 200, T.snippet) == "x " + "y" * 98


@pytest.mark.parametrize(
    "base,link,want",
    [
        ("http://a.test:80/x/y.html", "z.html#t", "http://a.test:80/x/z.html"),
        ("http://a.test:80/x/y.html", "../q/./r?s=1", "http://a.test:80/q/r?s=1"),
        ("http://a.test:80/x/", "/abs", "http://a.test:80/abs"),
        ("https://a.test:443/x", "//b.test/c", "https://b.test:443/c"),
        ("http://a.test:80/x", "https://b.test", "https://b.test:443/"),
        ("http://a.test:80/x", "HTTP://b.test:81?q", "http://b.test:81/?q"),
        ("http://a.test:80/x", "mailto:me@b.test", None),
        ("http://a.test:80/x", "/pic.jpg", None),
        ("http://a.test:80/x", "/pic.jpg?x", None),
        ("http://a.test:80/x", None, None),
        ("http://a.test:80/x/", "./", "http://a.test:80/x/"),
    ],
)
def test_absolute(spark, base, link, want):
    df = spark.createDataFrame([(base, link)], "b string, l string")
    assert df.select(U.absolute(F.col("b"), F.col("l"))).first()[0] == want


def test_url_functions(spark):
    assert one(spark, """<A class=x HREF='/a'>1</a><a href="/b#c">2</a><a href=/d>3</a><a href=" /e ">""", U.links) == ["/a", "/e"]
    assert one(spark, """<a href=/d id=1><A  class="q" href='/e#f'><abbr href=/no><a name=x>""", U.raw_links) == ["/d", "/e#f"]
    assert tuple(one(spark, "http://a.test:81/p?q", U.parts)) == ("http", "a.test", "81", "/p?q")
    assert tuple(one(spark, "https://a.test", U.parts)) == ("https", "a.test", None, "/")
    assert tuple(one(spark, "x/y", U.parts)) == (None, None, None, "x/y")
    assert one(spark, "/a/../../b//c/./", U.normalize_path) == "/b/c" and one(spark, "/..", U.normalize_path) == ""
    assert one(spark, "http://a.test/x?a b=c&d", U.sanitize) == "http://a.test/x?a+b=c&d"
    assert one(spark, "http://a.test/x y", U.sanitize) == "http://a.test/x+y"
    assert one(spark, "http://a.test:80/b/c//", U.depth) == 5
    hit = lambda u: one(spark, u, lambda c: U.matches_any(c, [r".*/tags/.*", r".*\.pdf$"]))
    assert [hit(u) for u in (None, "", "http://a/TAGS/b", "http://a/tags/", "http://a/x.PDF/", "http://a/x.pdfs")] == [True, True, True, False, True, False]
    marked = lambda u: one(spark, u, U.language_marked)
    assert [marked(u) for u in ("http://a/de/x", "http://a/x?lang=fr", "http://a/deep", "http://a/x/es")] == [True, True, False, True]


def test_robots(spark):
    text = "# c\nUser-agent: *\nDisallow: /a\nCrawl-delay: 2\nUser-agent: other\nDisallow: /\nUser-Agent: Mine\nAllow: /b\nDisallow:\nnonsense"
    df = spark.createDataFrame([(text, "mine"), (text, "none"), (None, "x"), ("Crawl-delay: 9", "x")], "t string, a string")
    got = [r[0] for r in df.select(U.parse_robots(F.col("t"), F.col("a"))).collect()]
    assert [tuple(r) for r in got[0]["rules"]] == [("allow", "/b"), ("disallow", "")]
    assert [tuple(r) for r in got[1]["rules"]] == [("disallow", "/a")] and got[1]["crawl_delay"] == 2.0
    assert got[2]["rules"] == [] and got[3]["rules"] == []
    rules = spark.createDataFrame([("allow::/a,,disallow::/,,junk",)], "p string").select(U.unpack_rules(F.col("p")).alias("r"))
    assert rules.select(U.pack_rules(F.col("r"))).first()[0] == "allow::/a,,disallow::/,,"
    ok = lambda path: rules.select(U.allowed(F.lit(path), F.col("r"))).first()[0]
    assert ok("/a/b") and not ok("/b")
    assert spark.range(1).select(U.allowed(F.lit("/"), F.lit(None).cast("array<struct<rule_type:string,prefix:string>>"))).first()[0]


@pytest.mark.parametrize(
    "text,agent,rules,delay",
    [
        ("User-agent: a\nUser-agent: b\nDisallow: /x # no\n\nUser-agent: *\nDisallow: /", "a", [("disallow", "/x")], None),
        ("user-agent: B\nAllow: /y\nCrawl-delay: 2.5\nCrawl-delay: soon", "b", [("allow", "/y")], 2.5),
        ("User-agent: a\nAllow: /1\nUser-agent: c\nAllow: /2\nUser-agent: a\nAllow: /3", "a", [("allow", "/1"), ("allow", "/3")], None),
        ("Disallow: /early\nUser-agent: *\nDisallow:\nSitemap: http://x", "a", [("disallow", "")], None),
        ("# nothing\nno field", "a", [], None),
        (None, None, [], None),
    ],
)
def test_robots_groups(spark, text, agent, rules, delay):
    df = spark.createDataFrame([(text, agent)], "t string, a string").select(U.parse_robots(F.col("t"), F.col("a")).alias("p"))
    got = df.first()["p"]
    assert ([tuple(r) for r in got["rules"]], got["crawl_delay"]) == (rules, delay)


def test_language_of_hosts_and_regions(spark):
    urls = ["http://french.news.test/", "https://pt-br.shop.test:80/x", "http://news.test/french", "http://french.test/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(U.language_host(F.col("u"), ["french", "pt-br"])).collect()] == [True, True, False, False]
    assert [r[0] for r in spark.createDataFrame([("http://a.test/pt-br/x",), ("http://a.test/x?lang=pt-br",), ("http://a.test/ptbr/",)], "u string").select(U.language_marked(F.col("u"), ["pt-br"])).collect()] == [True, True, False]
