"""Every registered query against its DuckDB SQL over the smallest tables."""

from __future__ import annotations

import pytest

from loamgrid import registry
from tests.compare import database, differences

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, tmp_path):
    with database(sf_dir, str(tmp_path)) as db:
        assert not differences(QUERIES[name], SQL[name], spark, sf_dir, db)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
