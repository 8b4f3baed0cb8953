"""The lake: what is written, what the manifest says of it, and what a read touches."""

import hashlib
from pathlib import Path

import pytest

from tidegrid.sinks.lake import Lake

SCHEMA = "interval string, symbol string, open_time timestamp, close double"


def bars(spark, symbols, n=40, scale=1.0):
    return spark.createDataFrame([("1d", s, i * 86400, scale * i) for s in symbols for i in range(n)], "interval string, symbol string, s long, close double").selectExpr("interval", "symbol", "timestamp_seconds(s) AS open_time", "close")


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(spark, str(tmp_path / "lake"))
    out.write_bars(bars(spark, "abc"))
    return out


def files(lake, dataset="klines"):
    root = Path(lake.root) / dataset
    return {"/" + str(p.relative_to(root)): p for p in root.rglob("*.parquet")}


def test_manifest_rows_are_the_files(lake):
    rows, on_disk = lake.manifest().collect(), files(lake)
    assert {r.path for r in rows} == set(on_disk) and len(rows) == len(on_disk)
    for r in rows:
        data = on_disk[r.path].read_bytes()
        assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert sum(r.rows for r in rows) == 120 and {r.symbol for r in rows} == set("abc")
    assert (min(r.first_ts for r in rows) - max(r.last_ts for r in rows)).days == -39


def test_writing_again_replaces_only_its_symbols(spark, lake):
    before, version = {r.path: r.sha256 for r in lake.manifest().collect()}, lake.manifest_hash()
    lake.write_bars(bars(spark, "b", 25, 2.0))
    after = {r.path: r for r in lake.manifest().collect()}
    assert set(after) == set(files(lake)) and len(after) == len({r.path for r in after.values()})
    assert {p: h for p, h in before.items() if "symbol=b" not in p} == {p: r.sha256 for p, r in after.items() if r.symbol != "b"}
    assert sum(r.rows for r in after.values() if r.symbol == "b") == 25 and lake.manifest_hash() != version
    assert {r.state for r in lake.verify().collect()} == {"same"}
    assert lake.read_bars(symbols=["b"]).agg({"close": "max"}).first()[0] == 48


def test_manifest_hash_is_that_of_its_lines(lake):
    rows = sorted((r.dataset, r.path, r.rows, r.sha256) for r in lake.manifest().collect())
    assert lake.manifest_hash() == hashlib.sha256("".join("|".join(map(str, r)) + "\n" for r in rows).encode()).hexdigest()


def test_read_prunes_partitions(lake):
    plan = lake.read_bars(interval="1d", symbols=["a"])._jdf.queryExecution().explainString(lake.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    assert {Path(f).parent.name for f in lake.read_bars(symbols=["a"]).inputFiles()} >= {"symbol=a"}


def test_large_symbols_have_many_files(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "big"), rows_per_file=100)
    lake.write_bars(bars(spark, "xy", 950))
    rows = lake.manifest().collect()
    assert sum(r.rows for r in rows) == 1900 and max(r.rows for r in rows) <= 100 and len(rows) == len(files(lake))


def test_reference_tables_and_damage(spark, lake):
    lake.write_reference("names", spark.createDataFrame([("a", 1)], "name string, n int"))
    lake.write_reference("names", spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int").coalesce(1))
    rows = lake.manifest().where("dataset = 'reference.names'").collect()
    assert sum(r.rows for r in rows) == 2 and {r.path for r in rows} == set(files(lake, "reference/names"))
    harmed = next(iter(files(lake, "reference/names").values()))
    harmed.write_bytes(harmed.read_bytes() + b" ")
    (harmed.parent / f".{harmed.name}.crc").unlink(missing_ok=True)
    assert {r.state for r in lake.verify("reference/names").collect()} == {"changed"}
    assert {r.state for r in lake.verify().collect()} == {"same"}


def test_nothing_to_write(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "none"))
    lake.write_bars(bars(spark, "a"))
    lake.write_bars(spark.createDataFrame([], SCHEMA))
    assert lake.manifest().agg({"rows": "sum"}).first()[0] == 40
