import pytest

from quillspan.plans import data_queries, reference_queries
from tests.tables import SCHEMAS, write


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {odd: write(spark, f"file://{tmp_path_factory.mktemp('t')}", odd) for odd in (False, True)}


OWN = [n for n in reference_queries.QUERIES if not any(t in reference_queries.ORACLES.get(n, "") for t in ("lineitem", "orders", "customer", "nation", "supplier", "part ", "part where")) and n not in ("sample_elements", "pagerank_converged")]


@pytest.mark.parametrize("name", data_queries.QUERIES)
def test_empty_tables(spark, folders, name):
    assert data_queries.QUERIES[name](spark, folders[False]).count() == 0


@pytest.mark.parametrize("name", data_queries.QUERIES)
def test_odd_tables(spark, folders, name):
    rows = data_queries.QUERIES[name](spark, folders[True]).collect()
    assert len(rows) == len(set(rows))
    if name == "p7_found":
        assert [r["crawl_id"] for r in rows] == [7]
    if name == "p4_found":
        assert {r["url"] for r in rows} <= {"http://a.test:80/x"}


@pytest.mark.parametrize("name", OWN)
def test_own_operators_on_empty_and_odd_tables(spark, folders, name):
    for folder in folders.values():
        reference_queries.QUERIES[name](spark, folder).collect()


def test_every_table_is_covered():
    assert len(SCHEMAS) == 10
