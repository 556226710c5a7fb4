import pytest

from quillspan.llm import queries as Q
from tests.tables import write


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {odd: write(spark, f"file://{tmp_path_factory.mktemp('t')}", odd) for odd in (False, True)}


@pytest.mark.parametrize("name", Q.QUERIES)
def test_empty_tables(spark, folders, name):
    assert Q.QUERIES[name](spark, folders[False]).count() == 0


@pytest.mark.parametrize("name", Q.QUERIES)
def test_odd_tables(spark, folders, name):
    Q.QUERIES[name](spark, folders[True]).collect()


def test_p5_found_ranks_candidates_without_a_score(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, "t")], "query_id long, term string").write.parquet(f"{d}/search_queries.parquet")
    spark.createDataFrame([(f"d{i:02}", "t", 1.0 - i / 100, 0) for i in range(40)], "doc string, term string, value double, chunk int").write.parquet(f"{d}/pt_tf.parquet")
    spark.sql("select 'd39' as page_key, 1.0D as rank, 1.0D as prev, timestamp'2024-01-01' as computed_at").write.parquet(f"{d}/pt_pageranks.parquet")
    # By rank d39 is first, then come those without one by name; by value d00, d01, d02, d03.
    assert {r["page_key"] for r in Q.p5_found(spark, d).collect()} == {"d00", "d01", "d02"}
