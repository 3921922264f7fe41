"""Every registered query of the document operators against its SQL, and runs of those without."""

from __future__ import annotations

import pytest
from engines import duck, same

from pagelith.plans import registry


@pytest.fixture(scope="module")
def connection(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, data, connection, name):
    same(registry.QUERIES[name](spark, data), registry.ORACLES[name], connection)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry_imports_and_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_projection_reaches_the_scan(spark, data):
    plan = registry.QUERIES["token_estimate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "IsNotNull(text)" in plan
