"""Queries with SQL give DuckDB's rows on whole tables."""

import pytest
from compare import rows
from conftest import DATA

from tidegrid.llm import queries


@pytest.mark.parametrize("name", ["op11_conversations", "op13_merkle_manifest"])
def test_oracle(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())
