"""Plans are the ones meant: filters and columns reach the scan, no cross joins, Python only where it must be."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators.dataset import Engine
from quillspan.operators.packed import explode_packed
from quillspan.plans import data_queries, reference_queries
from quillspan.plans import jobs as J
from quillspan.sources.store import TableStore
from tests.tables import write


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, f"file://{tmp_path_factory.mktemp('t')}", True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_ranges_reach_the_scan(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    store.write("t", spark.createDataFrame([(f"k{i}", i, "wide") for i in range(50)], "key string, v int, w string"))
    p = plan(store.scan("t", "k1", "k3").select("key", "v"))
    assert "GreaterThanOrEqual(key,k1)" in p and "LessThan(key,k3)" in p and "struct<key:string,v:int>" in p


def test_from_table_pushes_filters_and_columns(spark, folder):
    t = spark.read.parquet(f"{folder}/pt_crawl.parquet")
    p = plan(Engine(spark).from_table(t.where("response_code = 1"), F.col("url")).df)
    assert "EqualTo(response_code,1)" in p and "ReadSchema: struct<url:string,response_code:int>" in p


def test_packed_fields_and_terms_stay_in_the_jvm(spark, folder):
    t = spark.read.parquet(f"{folder}/pt_index.parquet")
    p = plan(explode_packed(t.select("posting_id", "urls"), "urls"))
    assert "Exchange" not in p and "Python" not in p and "Arrow" not in p
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    p = plan(J.term_frequency(docs, "doc_id", "text"))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_sum" in p


@pytest.mark.parametrize("name", [*data_queries.QUERIES, "search_topk", "pagerank", "frontier", "inverted_index", "robots_allowed", "host_cap"])
def test_no_cross_joins(spark, folder, name):
    df = {**reference_queries.QUERIES, **data_queries.QUERIES}[name](spark, folder)
    assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
