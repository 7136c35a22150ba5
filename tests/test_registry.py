"""The registry itself: what is registered, checked and how it plans."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck
from conftest import SF
from plumbline.plans.registry import ORACLES, QUERIES

NO_SQL: set[str] = set()
STREAMS = {"change_feed", "stream_check", "request_rate", "atomic_sink", "stream_result_cache", "stream_history"}


def test_every_query_has_sql_but_the_named_ones():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "compliant" in df.columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - {"persist_checks", "load_tables"}))
def test_no_pairwise_joins_and_no_row_udfs(spark, name):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    for bad in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["corridor_check", "validate_requests", "evaluate_rules", "result_cache", "rerank"])
def test_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, name) == ""
