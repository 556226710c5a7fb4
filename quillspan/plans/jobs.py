"""Pipelines: term statistics, index, links and ranks, search, crawl frontier.

Costly arrays are exploded by ``explode_outer`` with a filter behind it: for ``explode`` the optimizer adds
a filter on the array's size before it, for which the array would be made once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.hashing import row_key
from quillspan.functions.stem import stem, with_stems
from quillspan.operators.joins import join_small
from quillspan.operators.upsert import newest
from quillspan.session import materialize, release

#: Most urls in one packed row of the index; larger terms have several rows.
PACKED_URLS = 100_000


def term_frequency(docs: DataFrame, doc: str, text: str, stems: bool = False) -> DataFrame:
    """(doc, term, tf): share of a document's tokens, a leading empty one included; rows of one document add up.

    Shares are summed per term before the shuffle and, with ``stems``, before the join with the stemmed
    vocabulary, so that only distinct words move.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), T.plain(F.col(text)).alias("plain"))
    return _frequencies(rows.select("doc", T.counted_words(F.col("plain")).alias("w")), stems)


def page_term_frequency(crawl: DataFrame, stems: bool = False) -> DataFrame:
    """(doc, term, tf) of each page's last fetch. Words are found where the page lies; no page is moved."""
    last = latest_pages(crawl, w=T.counted_words(T.plain(F.col("page"))))
    return _frequencies(last.select(F.col("page_key").alias("doc"), "w"), stems)


def _frequencies(counted: DataFrame, stems: bool) -> DataFrame:
    each = counted.select("doc", (1 / F.col("w.n")).alias("share"), F.explode_outer("w.words").alias("term")).where("term is not null")
    tf = each.groupBy("doc", "term").agg(F.sum("share").alias("tf"))
    if not stems:
        return tf
    return with_stems(tf, "term", spread=["doc"]).groupBy("doc", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def document_frequency(pairs: DataFrame) -> DataFrame:
    """(term, df) of (doc, term) rows, each document once a term."""
    return pairs.select("doc", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_log(pairs: DataFrame, documents: int) -> DataFrame:
    """ln(N / df)."""
    return document_frequency(pairs).select("term", F.log(F.lit(float(documents)) / F.col("df")).alias("idf"))


def idf_smoothed(pairs: DataFrame, documents: int) -> DataFrame:
    """ln(N / (1 + df)), below zero for terms of all documents."""
    return document_frequency(pairs).select("term", F.log(F.lit(float(documents)) / (1 + F.col("df"))).alias("idf"))


def index_documents(pairs: DataFrame) -> int:
    """Documents of an index: the different urls of its (term, url) rows."""
    return pairs.agg(F.countDistinct("url")).first()[0]


def index_idf(pairs: DataFrame) -> DataFrame:
    """ln(N / (1 + df)) of an index's (term, url) rows, N being its different urls."""
    return idf_smoothed(pairs.select("term", F.col("url").alias("doc")), index_documents(pairs))


def postings(docs: DataFrame, url: str, text: str, lexicon: DataFrame | None = None, stems: bool = False) -> DataFrame:
    """(term, url) once each; words are stemmed first with ``stems``, and only terms of a lexicon stay where one is given."""
    return _postings(docs.select(F.col(url).alias("url"), F.array_distinct(T.words(F.col(text))).alias("terms")), lexicon, stems)


def page_postings(crawl: DataFrame, lexicon: DataFrame | None = None, stems: bool = False) -> DataFrame:
    """``postings`` of each page's last fetch. Words are found where the page lies; no page is moved."""
    return _postings(latest_pages(crawl, terms=F.array_distinct(T.words(F.col("page")))).select("url", "terms"), lexicon, stems)


def _postings(found: DataFrame, lexicon: DataFrame | None, stems: bool) -> DataFrame:
    rows = found.select("url", F.explode_outer("terms").alias("term")).where("term is not null and url is not null")
    if stems:
        rows = with_stems(rows.distinct(), "term", spread=["url"]).select("url", F.col("stem").alias("term"))
    if lexicon is not None:
        rows = join_small(rows, lexicon.select("term").distinct(), ["term"], "left_semi", spread=["url"])
    return rows.select("term", "url").distinct()


def unpacked_index(index: DataFrame) -> DataFrame:
    """(term, url) of packed (term, urls) rows, once each."""
    return index.select("term", F.explode_outer(F.split("urls", ",")).alias("url")).where("url is not null and url <> ''").distinct()


def packed_index(pairs: DataFrame, most: int = PACKED_URLS) -> DataFrame:
    """(term, shard, urls): sorted urls joined by commas. A term of more than ``most`` urls has several shards,
    so that no row or task holds an unbounded list."""
    pairs = materialize(pairs, "postings")
    sizes = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    shards = materialize(sizes.select("term", F.ceil(F.col("n") * 1.25 / most).alias("shards")), "index-shards")
    placed = join_small(pairs, shards, ["term"], "left", spread=["url"])
    shard = F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("url"), F.col("shards"))).cast("int")
    return placed.groupBy("term", shard.alias("shard")).agg(F.array_join(F.array_sort(F.collect_list("url")), ",").alias("urls"))


def merge_index(dest: DataFrame, source: DataFrame, once: bool = False) -> DataFrame:
    """Both indexes in one: common terms have their lists appended, or united with ``once``. Empty sources are skipped.

    (term, urls) rows, or with a ``shard`` where both have one: shards are joined each by itself, so a list
    stays as bounded as it was; with ``once`` a url must lie in the same shard of both.
    """
    on = ["term", "shard"] if "shard" in dest.columns and "shard" in source.columns else ["term"]
    s = source.where("urls is not null and urls <> ''").select(*on, F.col("urls").alias("more"))
    both = dest.join(s, on, "full_outer")
    joined = F.concat_ws(",", F.nullif(F.col("urls"), F.lit("")), "more")
    if once:
        joined = F.array_join(F.array_sort(F.array_distinct(F.split(joined, ","))), ",")
    return both.select(*on, F.when(F.col("more").isNull(), F.coalesce("urls", F.lit(""))).otherwise(joined).alias("urls"))


def extend_index(index: DataFrame, pairs: DataFrame, most: int = PACKED_URLS) -> DataFrame:
    """A packed index with further (term, url) rows, packed anew: lists are united and stay bounded."""
    return packed_index(unpacked_index(index).unionByName(pairs.select("term", "url")).distinct(), most)


def lexicon(words: DataFrame, word: str = "value") -> DataFrame:
    """(term): trimmed, lower-case, without stop words and empties, stemmed, once each."""
    tidy = words.select(F.lower(F.trim(F.col(word))).alias("w")).where((F.col("w") != "") & ~F.col("w").isin(T.STOP_WORDS)).distinct()
    return with_stems(tidy, "w").select(F.col("stem").alias("term")).distinct()


def seed_index(lex: DataFrame, index: DataFrame) -> DataFrame:
    """The index with an empty list for each lexicon term it lacks."""
    missing = lex.select("term").distinct().join(index.select("term"), "term", "left_anti")
    return index.select("term", "urls").unionByName(missing.select("term", F.lit("").alias("urls")))


def latest_pages(crawl: DataFrame, **what: Column) -> DataFrame:
    """(page_key, url, host, crawl_id) and ``what`` of each page's last fetch that has a body.

    ``what`` is made of the page where it lies; only that is moved to the page's other fetches.
    """
    rows = crawl.where("page is not null and page <> '' and page_key is not null").select("page_key", "url", "host", "crawl_id", *[c.alias(n) for n, c in what.items()])
    return newest(rows, ["page_key"], [F.col("crawl_id").desc_nulls_last(), F.col("url")])


def latest_links(crawl: DataFrame) -> DataFrame:
    """(page_key, url, links) of each page's last fetch, written once."""
    return materialize(latest_pages(crawl, links=U.links(F.col("page"))).select("page_key", "url", "links"), "links")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) per link, repeated ones included, of (page_key, url, links); links that resolve to nothing are left out."""
    each = pages.select(F.col("page_key").alias("src"), "url", F.explode_outer("links").alias("link"))
    return each.select("src", U.absolute(F.col("url"), F.col("link")).alias("to")).where("to is not null").select("src", row_key(F.col("to")).alias("dst"))


def pagerank(edges: DataFrame, nodes: DataFrame, *, damping: float = 0.85, epsilon: float = 0.01, share: float = 1.0, most_rounds: int = 100, rounds: int | None = None) -> DataFrame:
    """(id, rank, prev) of ``nodes`` (id): r' = (1 - d) + sum over links in of d * r / out-degree, from 1.

    Out-degrees count every link, repeated and to pages not among the nodes; what goes there is lost.
    Ends when at least ``share`` of the nodes changed by at most ``epsilon``, or after ``rounds``. Raises if
    ``most_rounds`` do not bring that about.
    """
    nodes = nodes.select("id").distinct()
    # Links are made once; repeated ones are summed before they meet the ranks.
    counted = materialize(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "counted")
    out = counted.groupBy("src").agg(F.sum("n").alias("degree"))
    weighted = counted.join(out, "src").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    weighted = materialize(weighted.select("src", "dst", (damping * F.col("n") / F.col("degree")).alias("w")), "edges")
    release(counted)
    ranks = materialize(nodes.select("id", F.lit(1.0).alias("rank"), F.lit(1.0).alias("prev")), "ranks")
    for done in range(1, (rounds or most_rounds) + 1):
        flow = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("rank")).alias("flow"))
        last, ranks = ranks, materialize(ranks.join(flow, "id", "left").select("id", (F.lit(1 - damping) + F.coalesce("flow", F.lit(0.0))).alias("rank"), F.col("rank").alias("prev")), "ranks")
        release(last)
        if rounds is None:
            still = ranks.agg(F.avg((F.abs(F.col("rank") - F.col("prev")) <= epsilon).cast("double"))).first()[0]
            if still is None or still >= share:
                break
            if done == most_rounds:
                raise RuntimeError(f"ranks have not converged in {most_rounds} rounds")
    release(weighted)
    return ranks


def search(words: DataFrame, tf: DataFrame, idf: DataFrame, ranks: DataFrame, *, n: int = 10, weight: float = 0.95) -> DataFrame:
    """(doc, score): the n best documents of the query's (term) rows.

    A document's score is the sum over matched terms of weight * tf * idf + (1 - weight) * rank; a missing
    tf, idf or rank counts 0. Ties go by document.
    """
    hits = join_small(tf.select("doc", "term", "tf"), words.select("term").distinct(), ["term"], spread=["doc"])
    hits = join_small(hits, idf.select("term", "idf"), ["term"], "left", spread=["doc"])
    by_doc = hits.groupBy("doc").agg(F.sum(weight * F.coalesce("tf", F.lit(0.0)) * F.coalesce("idf", F.lit(0.0))).alias("text"), F.count(F.lit(1)).alias("matched"))
    scored = by_doc.join(ranks.select(F.col("id").alias("doc"), "rank"), "doc", "left")
    return scored.select("doc", (F.col("text") + (1 - weight) * F.col("matched") * F.coalesce("rank", F.lit(0.0))).alias("score")).orderBy(F.col("score").desc(), "doc").limit(n)


def search_index(words: DataFrame, pairs: DataFrame, tf: DataFrame, idf: DataFrame, ranks: DataFrame, *, n: int = 10, weight: float = 0.95) -> DataFrame:
    """(url, score): the n best urls of an index's (term, url) rows for the query's (term) rows.

    Every posting of an asked term counts weight * tf * idf + (1 - weight) * rank, a missing tf, idf or rank
    being 0; a url's document is its row key. Ties go by url.
    """
    hits = join_small(pairs.select("term", "url"), words.select("term").distinct(), ["term"], "left_semi", spread=["url"])
    hits = hits.distinct().withColumn("doc", row_key(F.col("url")))
    hits = join_small(hits, idf.select("term", "idf"), ["term"], "left", spread=["url"])
    asked = join_small(tf.select("doc", "term", "tf"), words.select("term").distinct(), ["term"], "left_semi", spread=["doc"])
    found = hits.join(asked, ["doc", "term"], "left").groupBy("url", "doc").agg(F.sum(F.coalesce("tf", F.lit(0.0)) * F.coalesce("idf", F.lit(0.0))).alias("text"), F.count(F.lit(1)).alias("matched"))
    scored = found.join(ranks.select(F.col("id").alias("doc"), "rank"), "doc", "left")
    return scored.select("url", (weight * F.col("text") + (1 - weight) * F.col("matched") * F.coalesce("rank", F.lit(0.0))).alias("score")).orderBy(F.col("score").desc(), "url").limit(n)


def query_terms(spark: SparkSession, query: str, stems: bool = False) -> DataFrame:
    """(term): the different words of a query, stemmed with ``stems``."""
    words = spark.createDataFrame([(query,)], "q string").select(F.explode(T.query_words(F.col("q"))).alias("term"))
    return words.select(stem(F.col("term")).alias("term")).distinct() if stems else words


def with_snippets(best: DataFrame, crawl: DataFrame) -> DataFrame:
    """(doc, url, preview, score): the few best documents with the start of their last fetch's text.

    ``best`` is short: the result of a search for n documents, n the caller's. Pages are told by (page_key, url, page), and
    fetches of one page by ``crawl_id`` where there is one.
    """
    asked = join_small(crawl.where("page is not null and page <> ''"), best.select(F.col("doc").alias("page_key")), ["page_key"], "left_semi", spread=["url"])
    version = ["crawl_id"] if "crawl_id" in crawl.columns else []
    found = asked.select(F.col("page_key").alias("doc"), "url", T.snippet(F.col("page")).alias("preview"), *version)
    found = newest(found, ["doc"], [*(F.col(c).desc_nulls_last() for c in version), F.col("url")])
    return best.select("doc", "score").join(found.select("doc", "url", "preview"), "doc", "left")


def as_json(results: DataFrame) -> DataFrame:
    """One row ``json``: the list of {url, preview} in order of the score; a response holds few results."""
    item = F.struct(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("preview", F.lit("")).alias("preview"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc"), item.alias("i"))))
    return results.agg(F.to_json(F.transform(ordered, lambda x: x["i"])).alias("json"))


def first_per_group(df: DataFrame, group: str, order: list[Column], n: int, spread: str, salts: int = 32) -> DataFrame:
    """The first n rows of each group, in two stages: a hot group's rows are cut down per salt before they meet."""
    w = Window.partitionBy(group, "__salt").orderBy(*order)
    part = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return part.drop("__salt").withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def admit(found: DataFrame, seen: DataFrame, hosts: DataFrame, *, cap: int = 1000, most_depth: int = 5, codes: list[str] | None = None, patterns: list[str] = ()) -> DataFrame:
    """(url, host): the urls of a crawl's next round.

    Of the (url) rows found: new ones, once each, no deeper than ``most_depth``, free of the language
    ``codes`` and ``patterns`` (a rule that allows outranks patterns), allowed by the host's rules, and per host
    as many as ``cap`` leaves over its ``url_count``.
    """
    new = found.where("url is not null and url <> ''").select("url").distinct().join(seen.select("url"), "url", "left_anti")
    new = new.withColumn("host", U.host(F.col("url"))).where(F.col("host").isNotNull() & (U.depth(F.col("url")) <= most_depth))
    if codes:
        new = new.where(~U.language_marked(F.col("url"), codes))
    rules = hosts.groupBy("host").agg(F.first("rules", True).alias("rules"), F.coalesce(F.max("url_count"), F.lit(0)).alias("url_count"))
    known = join_small(new, rules, ["host"], "left", spread=["url"])
    path = F.regexp_extract("url", "^[^/]*//[^/]*([^?]*)", 1)
    ruled = F.size(F.filter(F.coalesce("rules", F.array().cast("array<struct<rule_type:string,prefix:string>>")), lambda r: F.startswith(path, F.coalesce(r["prefix"], F.lit(""))))) > 0
    ok = known.where(U.allowed(path, F.col("rules")) & (ruled | ~U.matches_any(F.col("url"), list(patterns))))
    return first_per_group(ok, "host", [F.col("url")], cap, "url").withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("url"))).where(F.col("n") + F.coalesce("url_count", F.lit(0)) <= cap).select("url", "host")


def crawl_round(crawl: DataFrame, seen: DataFrame, hosts: DataFrame, **rules) -> DataFrame:
    """(url, host) of a crawl's next round: the links of all pages, quoted or bare, in the crawl's form, as ``admit`` lets them in."""
    pages = latest_pages(crawl, links=U.raw_links(F.col("page")))
    found = pages.select("url", F.explode_outer("links").alias("link")).select(U.crawl_form(F.col("url"), F.col("link")).alias("url"))
    return admit(found, seen, hosts, **rules)


def crawl_all(fetch: Callable[[DataFrame], DataFrame], seeds: DataFrame, hosts: DataFrame, most_rounds: int = 1000, **rules) -> DataFrame:
    """All fetches (as in the crawl table) from seeds (url) on, round by round until no url is left.

    ``fetch`` gives the fetches of (url, host) rows, one a url at most. A url is asked for once. A host's count grows with its
    fetched urls, so its cap holds over all rounds. Raises if urls are left after ``most_rounds``.
    """
    seen = hosts.sparkSession.createDataFrame([], "url string")
    queue = admit(seeds, seen, hosts, **rules)
    done: DataFrame | None = None
    for _ in range(most_rounds):
        queue = materialize(queue, "queue")
        if queue.isEmpty():
            return done if done is not None else fetch(queue)
        seen = materialize(seen.unionByName(queue.select("url")), "seen")
        got = materialize(fetch(queue), "fetched")
        done = got if done is None else materialize(done.unionByName(got), "crawled")
        held = hosts.join(seen.select(U.host(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("__asked")), "host", "left")
        counted = held.withColumn("url_count", F.coalesce("url_count", F.lit(0)) + F.coalesce("__asked", F.lit(0))).drop("__asked")
        queue = crawl_round(got, seen, counted, **rules)
    raise RuntimeError(f"urls are left after {most_rounds} rounds")


def reshard(pages: DataFrame, partitions: int) -> DataFrame:
    """Pages by the hash of their url, in as many partitions."""
    return pages.withColumn("key", row_key(F.col("url"))).repartition(partitions, "key")
