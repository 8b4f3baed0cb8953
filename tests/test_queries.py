"""Every market query with SQL gives DuckDB's rows; the others give rows."""

import pytest
from compare import rows
from conftest import DATA

from tidegrid import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_executions_are_sorted_once(spark, tmp_path):
    """One sort of executions and one of orders; ids that repeat in orders give every copy its sum."""
    import duckdb
    import pandas as pd
    from compare import rows
    from tidegrid import catalog

    lines = pd.DataFrame({"l_orderkey": [1, 1, 1, 2, 2, 3], "l_linenumber": [1, 2, 2, 1, 1, 1], "l_extendedprice": [5.0, 7.25, 7.25, 1.5, 2.5, 9.0], "l_quantity": [1.0] * 6, "l_shipdate": pd.to_datetime(["2024-01-01"] * 6)})
    orders = pd.DataFrame({"o_orderkey": [1, 1, 1, 2, 4], "o_custkey": [1] * 5, "o_totalprice": [10.0, 30.0, 20.0, 3.0, 1.0], "o_orderstatus": ["O"] * 5, "o_orderdate": pd.to_datetime(["2024-01-01"] * 5)})
    con = duckdb.connect()
    for name, frame in (("lineitem", lines), ("orders", orders)):
        frame.to_parquet(tmp_path / f"{name}.parquet", index=False, coerce_timestamps="us")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = catalog.QUERIES["jr_execution"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2
    got, want = got.toPandas(), con.execute(catalog.ORACLE_SQL["jr_execution"]).df()
    cells = ["id", "seq", "done"]  # which copy of an order meets which sum is left open
    assert rows(got[cells]) == rows(want[cells]) and got.overfill[got.id == 2].tolist() == want.overfill[want.id == 2].tolist() == [False, True]
