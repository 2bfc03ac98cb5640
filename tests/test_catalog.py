import pytest

import __spark_entry__ as contract
from ledgermark import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    problems, rows = compare(spark, db, QUERIES[name], SQL[name], SF)
    assert not problems
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"io_roundtrip", "stream_ingest", "stored_completions", "definition_check", "json_array_scan", "json_array_blocks", "committed_run"}))
def test_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_hash_votes(spark):
    for name in ("vote_accuracy", "answer_program"):
        assert "SortAggregate" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
