import pytest

import __spark_entry__ as entry
from tests import oracle
from weftline.plans import catalog, pipeline_queries  # noqa: F401


#: Queries that need an answer with an id divisible by 100.
ASKED = {"bm25_top", "hybrid_fusion", "lexical_rerank", "filter_inference"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    data = "/root/testdata/sf0.01" if name in ASKED else data
    assert oracle.compare(spark, data, name, catalog.QUERIES[name], catalog.ORACLE[name]) == "ok"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    more = {"every": 30} if name == "compared_stages" else {}
    assert catalog.QUERIES[name](spark, data, **more).count() > 0


def test_whole_graph_queries_count_every_edge(spark, data):
    made = catalog.star_edges(spark, data, "made").count()
    films = catalog.QUERIES["all_works_by_studio"](spark, data).agg({"films": "sum"}).first()[0]
    assert films == made > catalog.QUERIES["works_by_studio"](spark, data).agg({"films": "sum"}).first()[0]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
