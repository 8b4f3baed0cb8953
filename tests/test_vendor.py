import gzip
import hashlib
import json
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from tidegrid.sources import vendor


def test_klines_of_both_units_keep_the_last_row(spark, tmp_path):
    head = "open_time,open,high,low,close,volume,close_time,quote_volume,trades,a,b,c\n"
    (tmp_path / "XUSD-1d-2024-12.csv").write_text(head + "1704067200000,1,2,0.5,1.5,10,0,15,3,1,1,0\nbroken\n1704067200000,1,2,0.5,1.7,10,0,17,3,1,1,0\n")
    (tmp_path / "XUSD-1d-2025-01.csv").write_text("1735689600000000,2,3,1,2.5,x,0,25,4,1,1,0\n")
    got = vendor.klines(spark, f"{tmp_path}/*.csv").orderBy("open_time").collect()
    assert [(r.symbol, r.open_time, r.close, r.volume, r.trades) for r in got] == [("XUSD", datetime(2024, 1, 1), 1.7, 10.0, 3), ("XUSD", datetime(2025, 1, 1), 2.5, None, 4)]


def test_zipped_lines_and_checksums(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "Y-f.zip", "w") as z:
        z.writestr("Y-f.csv", "calc_time,h,r\n1704067200000,8,0.01\n1704096000000,8,-0.02\n")
    (tmp_path / "Y-f.zip.CHECKSUM").write_text(hashlib.sha256((tmp_path / "Y-f.zip").read_bytes()).hexdigest() + "  Y-f.zip\n")
    assert [r.ok for r in vendor.verified(spark, str(tmp_path)).collect()] == [True]
    day = vendor.daily_funding(vendor.funding(spark, f"{tmp_path}/*.zip")).collect()
    assert [(r.symbol, r.day, round(r.rate, 9), r.settlements) for r in day] == [("Y", date(2024, 1, 1), -0.01, 2)]


def test_open_interest_takes_text_and_epochs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("create_time,symbol,a,b\n2024-01-01 00:05:00,X,1,2\n1704067200000,X,3,4\n")
    got = vendor.open_interest(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.t, r.open_interest) for r in got] == [(datetime(2024, 1, 1), 3.0), (datetime(2024, 1, 1, 0, 5), 1.0)]


def test_eod_bars_fall_back_to_raw_prices(spark, tmp_path):
    row = {"date": "2024-01-02T00:00:00.000Z", "open": 10, "high": 12, "low": 8, "close": 10, "volume": 100, "adjOpen": 5, "adjHigh": 6, "adjLow": 4, "adjClose": 5, "divCash": 0, "splitFactor": 1}
    (tmp_path / "SPY.json").write_text(json.dumps([row, row | {"date": "2024-01-03", "adjClose": None}]))
    a, b = vendor.eod_bars(spark, str(tmp_path)).orderBy("day").collect()
    assert (a.symbol, a.close, a.volume, a.quote_volume, a.close_unadjusted) == ("SPY", 5.0, 200.0, 1000.0, 10.0)
    assert (b.close, b.volume) == (10.0, 100.0)


def test_series(spark, tmp_path):
    for name, text in {"r/DGS3.csv": "observation_date,DGS3\n2024-01-01,5.25\n2024-01-02,.\n", "v/d.json": "[[1704067200000,1,2,0,1],[1704067200001,9,9,9,9]]", "g/g.json": '{"data":[{"timestamp":"1704067200","value":"40","value_classification":"Fear"}]}'}.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    assert [(r.series, r.rate) for r in vendor.rate_series(spark, f"{tmp_path}/r").orderBy("day").collect()] == [("DGS3", 0.0525), ("DGS3", None)]
    assert [(r.day, r.close) for r in vendor.daily_arrays(spark, f"{tmp_path}/v").collect()] == [(date(2024, 1, 1), 1.0)]
    assert [tuple(r) for r in vendor.daily_index(spark, f"{tmp_path}/g").collect()] == [(date(2024, 1, 1), 40.0, "Fear")]


def test_short_side(spark, tmp_path):
    (tmp_path / "f.txt").write_text("SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE\n20240701|1| AB |5|x|1.5\n20240701|2|CD|7|x|y|1.5\ntrailer\n")
    got = vendor.fails_to_deliver(spark, str(tmp_path)).orderBy("cusip").collect()
    assert [(r.symbol, r.fails, r.price, r.event_time) for r in got] == [("AB", 5.0, 1.5, datetime(2024, 7, 1, 20)), ("CD", 7.0, None, datetime(2024, 7, 1, 20))]


def test_liquidations_skip_bad_lines(spark, tmp_path):
    good = json.dumps({"symbol": "X", "qty": "2", "price": "10", "side": "SELL", "event_time_ms": 1704067200000})
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(f"{good}\n{{broken\n\n{good.replace('SELL', 'buy').replace('X', 'Z')}\n")
    got = vendor.liquidations(spark, str(tmp_path), "v").orderBy("symbol").collect()
    assert [(r.symbol, r.dir, r.usd) for r in got] == [("X", "sell", 20.0), ("Z", "buy", 20.0)]
    scaled = vendor.liquidations(spark, str(tmp_path), "v", spark.range(1).select(F.lit("X").alias("symbol"), F.lit(0.1).alias("ctval"))).collect()
    assert [(r.symbol, r.usd) for r in scaled] == [("X", 2.0)]


def test_insider_trades_have_a_row_an_owner(spark):
    s = spark.createDataFrame([("a", "05-JAN-2024", "4/A")], "accession string, filing_date string, document_type string")
    t = spark.createDataFrame([("a", "03-JAN-2024", "10", ""), ("b", "03-JAN-2024", "1", "1")], "accession string, trans_date string, shares string, price string")
    o = spark.createDataFrame([("a", "1", "Director,Officer"), ("a", "2", "Other")], "accession string, owner_cik string, owner_relationship string")
    n = spark.createDataFrame([("a", "F2", "two"), ("a", "F1", "one")], "accession string, footnote_id string, footnote string")
    got = vendor.insider_trades(s, t, o, n).orderBy("owner_cik").collect()
    assert [(r.owner_cik, r.is_officer, r.is_amendment, r.footnotes, r.value_usd, r.event_time) for r in got] == [("1", True, True, "one | two", None, datetime(2024, 1, 3, 21)), ("2", False, True, "one | two", None, datetime(2024, 1, 3, 21))]
