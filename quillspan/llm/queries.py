"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.garbled import repair_texts
from quillspan.llm.mainbody import keyword_pages, main_pieces, main_text
from quillspan.llm.mixing import marginals, mix, prepare
from quillspan.llm.nearcopies import similar_classes, similar_pairs
from quillspan.llm.rankagg import order_statistics, rank_aggregate
from quillspan.llm.tokenize import encode_column
from quillspan.operators.joins import join_small
from quillspan.session import spread


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(table) if name in ("documents", "pt_crawl") else table  # texts take long in the tasks


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Fetches that have a page. Pages are not shuffled to drop the second deliveries; results are."""
    return _table(spark, d, "pt_crawl").where("page is not null and page <> ''").select("crawl_id", "host", "page")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return main_pieces(_deliveries(spark, d), ["crawl_id"]).select("crawl_id", "piece_no").distinct()


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each fetch as rendered text."""
    return main_text(_deliveries(spark, d), ["crawl_id"]).select("crawl_id", "main").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages(_deliveries(spark, d), ["crawl_id"]).where("keywords_only").select("crawl_id").distinct()


def _rankings(spark: SparkSession, d: str, final: bool) -> tuple[DataFrame, DataFrame]:
    """Rankings per asked term, and the queries (query_id, term)."""
    asked = _table(spark, d, "search_queries").where("query_id is not null and term is not null").select("query_id", "term").distinct()
    tf = _table(spark, d, "pt_tf").where("doc is not null and term is not null").select("doc", "term", "value")
    tf = join_small(tf, asked.select("term").distinct(), ["term"], "left_semi", spread=["doc"])
    # One shuffle by page serves both the removal of copies and the join.
    value = tf.repartition("doc").groupBy("doc", "term").agg(F.max("value").alias("value"))
    runs = _table(spark, d, "pt_pageranks").where("page_key is not null")
    rank = runs.groupBy(F.col("page_key").alias("doc")).agg(F.max(F.struct("computed_at", "rank")).alias("r")).select("doc", F.col("r.rank").alias("rank"))
    cands = value.join(rank, "doc", "left").withColumnRenamed("doc", "page_key")
    sizes = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return rank_aggregate(cands, "term", "page_key", ["rank", "value"], final=final, sizes=sizes), asked


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every query with its place in the aggregated ranking."""
    ranked, asked = _rankings(spark, d, True)
    return join_small(ranked, asked, ["term"], spread=["page_key"]).select("query_id", "page_key", "significance", "position")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ranked, asked = _rankings(spark, d, True)
    k = F.floor(F.col("n") / 10)
    # The last order statistic tells how high an item stands in every ranking at once (missing scores at their
    # positions): an item among the first k of both has at most the probability of rank k / n. The exact check follows.
    both = order_statistics([F.col("pos_rank") / F.col("n"), F.col("pos_value") / F.col("n")])[-1]
    top = ranked.where(F.col("position").isNotNull() & (both <= F.pow(k / F.col("n"), F.lit(2)) + 1e-12) & (F.col("pos_rank") <= k) & (F.col("pos_value") <= k))
    return join_small(top, asked, ["term"], spread=["page_key"]).select("query_id", "page_key")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pt_crawl").select("crawl_id", "page")
    return similar_pairs(pages, "crawl_id", "page", k=4, similarity=0.6, tags=True).select(F.col("id_a").alias("crawl_id_a"), F.col("id_b").alias("crawl_id_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """The group of each page that has a run of words, and its number of links to different pages."""
    pages = _table(spark, d, "pt_crawl").select("crawl_id", "page")
    return similar_classes(pages, "crawl_id", "page", k=4, similarity=0.6, tags=True).withColumnRenamed("id", "crawl_id")


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents that share four fifths of their runs of five words."""
    return similar_classes(_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(_table(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])


def _mix(spark: SparkSession, d: str, total: str | None) -> tuple[DataFrame, DataFrame]:
    return mix(prepare(_table(spark, d, "documents").select("doc_id", "text", "source", "lang")), _table(spark, d, "mix_targets"), total=total)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as all documents of the listed sources: small ones are repeated up to their cap."""
    return _mix(spark, d, "all")[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares of that mix."""
    return _mix(spark, d, "all")[1]


def p9_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the largest mix in which every source that has documents meets its share."""
    return _mix(spark, d, None)[1]


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics in all documents and in the mix."""
    ready = prepare(_table(spark, d, "documents").select("doc_id", "text", "source", "lang"))
    return marginals(ready, mix(ready, _table(spark, d, "mix_targets"), total="all")[0])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    got = repair_texts(_table(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the original text, null where it cannot be restored."""
    got = repair_texts(_table(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.where("garbled").select("doc_id", "restored", "layers")


QUERIES = {f.__name__: f for f in (p1_found, p1_text, p2_found, p5_found, p5_ranking, p6_found, p6_classes, p6_documents, p8_ids, p9_mix, p9_shares, p9_exact_shares, p9_marginals, p10_found, p10_restored)}
_RANKED = (
    "c as (select term, doc, max(value) as v from pt_tf where term is not null and doc is not null group by term, doc), r as (select page_key, arg_max_null(rank, computed_at) as rank from pt_pageranks group by page_key), "
    "x as (select term, doc, count(*) over (partition by term) as n, row_number() over (partition by term order by v desc nulls last, doc) as pv, row_number() over (partition by term order by rank desc nulls last, doc) as pr from c left join r on doc = r.page_key)"
)
ORACLES: dict[str, str] = {
    "p5_found": f"with {_RANKED} select distinct query_id, doc as page_key from x join search_queries using (term) where pv <= n // 10 and pr <= n // 10",
}
