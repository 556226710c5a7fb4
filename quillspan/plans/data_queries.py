"""Queries of the general data problems (p3, p4, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.compaction import compact
from quillspan.operators.packed import explode_packed, once_per_key, split_packed
from quillspan.operators.skew import count_rows, salted_aggregate, sum_of
from quillspan.session import materialize


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = once_per_key(_table(spark, d, "pt_index").select("posting_id", "urls"), "posting_id")
    return explode_packed(rows, "urls", value="url").select("posting_id", "pos", "url")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return once_per_key(_table(spark, d, "pt_index").select("posting_id", "term", "urls"), "posting_id", ["urls", "term"])


def _key_counts(spark: SparkSession, d: str) -> DataFrame:
    host = F.transform(split_packed(F.col("urls")), lambda u: F.regexp_extract(u, r"^[^:]*://([^:/]*)", 1))
    # Split once: the sketch of heavy keys and the aggregation both read the short result.
    rows = materialize(_postings(spark, d).select("posting_id", "term", host.alias("hosts")), "postings")
    terms = rows.where("term is not null").select("posting_id", F.lit("term").alias("key_kind"), F.col("term").alias("key_name"), F.coalesce(F.size("hosts"), F.lit(0)).cast("long").alias("values"))
    hosts = rows.where("size(hosts) > 0").select("posting_id", "hosts", F.explode(F.array_distinct("hosts")).alias("key_name"))
    hosts = hosts.select("posting_id", F.lit("host").alias("key_kind"), "key_name", F.size(F.filter("hosts", lambda h: h == F.col("key_name"))).cast("long").alias("values"))
    return salted_aggregate(terms.unionByName(hosts), ["key_kind", "key_name"], {"n_rows": count_rows(), "n_values": sum_of("values")}, ["posting_id"])


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and values per term and per host."""
    return _key_counts(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(_key_counts(spark, d), "key-counts")
    # The two totals are single numbers.
    postings = _table(spark, d, "pt_index").agg(F.countDistinct("posting_id")).first()[0]
    values = counts.where("key_kind = 'host'").agg(F.coalesce(F.sum("n_values"), F.lit(0))).first()[0]
    term = (F.col("key_kind") == "term") & (F.col("n_rows") * 40 >= postings)
    host = (F.col("key_kind") == "host") & (F.col("n_values") * 40 >= values)
    return counts.where(term | host).select("key_kind", "key_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    done = compact(_table(spark, d, "crawl_files").select("file_id", "body"))
    return done.read(spark).where("crawl_id is not null").select("crawl_id")


def p7_layout(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated files: records and page bytes of each."""
    done = compact(_table(spark, d, "crawl_files").select("file_id", "body"))
    return done.read(spark).groupBy("bin").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("page")).alias("page_bytes"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p4_found, p7_found, p7_layout)}

_POSTINGS = "postings as (select distinct posting_id, term, urls from pt_index where posting_id is not null)"
# Every url of the index names its port, and no text inside a url does.
_HOSTS = "hosts_of as (select posting_id, unnest(regexp_extract_all(urls, 'https?://([^/:]+):[0-9]+/', 1)) as host from postings)"
ORACLES = {
    "p3_counts": f"with {_POSTINGS}, {_HOSTS} select 'term' as key_kind, term as key_name, count(*) as n_rows, sum(len(coalesce(regexp_extract_all(urls, 'https?://[^/:]+:[0-9]+/'), []))) as n_values from postings where term is not null group by term "
    "union all select 'host', host, count(distinct posting_id), count(*) from hosts_of group by host",
    "p3_found": f"with {_POSTINGS}, {_HOSTS} select 'term' as key_kind, term as key_name from postings where term is not null group by term having count(*) * 40 >= (select count(*) from postings) "
    "union all select 'host', host from hosts_of group by host having count(*) * 40 >= (select count(*) from hosts_of)",
}
