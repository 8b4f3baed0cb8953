"""Nested files of the shapes that vendors publish, with what is broken in them."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import nested


def test_screener_at_any_depth(spark, tmp_path):
    funds = {
        "239": {"fundName": "One", "localExchangeTicker": "IBIT", "totalNetAssets": {"r": 100.0, "d": "100"}, "navAmount": {"d": "9", "r": 25.0}},
        "240": {"deep": [{"x": {"ticker": "etha", "Shares Outstanding": "1,234.5", "netAssets": "$10", "nav": "-"}}], "localExchangeTicker": "OTHER"},
        "241": {"ticker": "NONE", "sharesOutstanding": 5},
    }
    (tmp_path / "a.json").write_text(json.dumps({"meta": [1, 2, [3]], "funds": funds, "again": {"ticker": "IBIT", "sharesOutstanding": 7}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"ticker": "IBIT", "sharesOutstanding": {"raw": "2,000"}, "totalNetAssets": None}, {"ticker": "IBIT", "sharesOutstanding": 1}]))
    (tmp_path / "c.json").write_text("<html>not this</html>")
    got = {(r.file, r.ticker): (r.shares_outstanding, r.total_net_assets, r.nav, r.shares_basis) for r in nested.fund_screener(spark, str(tmp_path), ["IBIT", "ETHA"]).collect()}
    assert got == {("a.json", "IBIT"): (7.0, None, None, "reported"), ("a.json", "ETHA"): (1234.5, 10.0, None, "reported"), ("b.json", "IBIT"): (2000.0, None, None, "reported")}
    del funds["239"]["fundName"]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "d.json").write_text(json.dumps({"x": [[{"y": funds["239"]}]]}))
    one = nested.fund_screener(spark, str(tmp_path / "only"), ["ibit"]).first()
    assert (one.shares_outstanding, one.shares_basis) == (4.0, "derived")


def test_walk_reaches_every_value(spark):
    doc = {"a": [1, {"b": None, "c": [[], {}]}], "d": "x"}
    rows = nested.walked(spark.createDataFrame([(1, json.dumps(doc)), (2, "3"), (3, "no json")], "doc int, j string").select("doc", F.try_parse_json("j").alias("v"))).collect()
    assert {(r.doc, tuple(r.path), r.key, r.kind) for r in rows} == {
        (1, (), None, "OBJECT"), (1, (0,), "a", "ARRAY"), (1, (1,), "d", "STRING"), (1, (0, 0), None, "BIGINT"), (1, (0, 1), None, "OBJECT"), (1, (0, 1, 0), "b", "VOID"), (1, (0, 1, 1), "c", "ARRAY"), (1, (0, 1, 1, 0), None, "ARRAY"), (1, (0, 1, 1, 1), None, "OBJECT"), (2, (), None, "BIGINT"),
    }
    with pytest.raises(ValueError, match="deeper"):
        nested.walked(spark.createDataFrame([(1, "[[[[]]]]")], "doc int, j string").select("doc", F.parse_json("j").alias("v")), deepest=2)


def test_workbook(spark, tmp_path):
    cell = lambda v: f'<ss:Cell><ss:Data ss:Type="String"> {v} </ss:Data></ss:Cell>'
    row = lambda *cells: f"<ss:Row>\n{''.join(map(cell, cells))}</ss:Row>"
    sheets = {
        "Holdings": [row("As Of", "Shares Outstanding"), row("Jan 01, 2024", "9")],
        "Historical": [row("As Of", "NAV per Share", "Ex-Dividends", "Shares Outstanding"), row("Oct 14, 2026", "50.5", "", "1200"), row("Oct 13, 2026", "50", "0.1", "1000"), row("Oct 12, 2026", "--", "", "900"), row("soon", "1", "", "2"), row("Oct 9, 2026", "40", "", "1100.5")],
    }
    body = "".join(f'<ss:Worksheet ss:Name="{n}"><ss:Table>{"".join(r)}</ss:Table></ss:Worksheet>' for n, r in sheets.items())
    (tmp_path / "F_2026.xls").write_text(f'<?xml version="1.0"?><ss:Workbook xmlns:ss="x">Terms & conditions{body}</ss:Workbook>')
    (tmp_path / "G_2026.xls").write_text("<html>sign in</html>")
    (tmp_path / "H_2026.xls").write_text('<ss:Workbook><ss:Worksheet ss:Name="Other"></ss:Worksheet></ss:Workbook>')
    got = [(str(r.day), r.nav, r.shares_outstanding, r.ex_dividend, r.flow_usd) for r in nested.fund_workbook(spark, str(tmp_path)).orderBy("day").collect()]
    assert got == [("2026-10-09", 40.0, 1100.5, None, None), ("2026-10-13", 50.0, 1000.0, "0.1", -100.5 * 50), ("2026-10-14", 50.5, 1200.0, None, 200 * 50.5)]


def test_recordings(spark, tmp_path):
    line = lambda t, raw: json.dumps({"recorded_at": t, "raw": raw if isinstance(raw, str) else json.dumps(raw)})
    poly = [
        line(1.5, [{"event_type": "book", "asset_id": "7", "bids": [{"price": "0.40"}, {"price": "0.45"}], "asks": [{"price": "0.6"}, {"price": "0.5"}]}, {"event_type": "tick"}]),
        line(2.0, {"event_type": "price_change", "price_changes": [{"asset_id": "7", "best_bid": "0.41", "best_ask": "0.52"}, {"asset_id": "8", "best_bid": "0.1"}, {"asset_id": "9", "best_bid": "x", "best_ask": "1"}]}),
        line(2.5, {"event_type": "last_trade_price", "asset_id": "7", "price": "0.5", "side": "BUY", "timestamp": "1"}),
        line(3.0, "not json"), "neither this", line(3.5, {"event_type": "book", "asset_id": "6", "bids": [], "asks": None}), json.dumps({"recorded_at": 4}),
    ]
    index = [line(1.0, {"method": "subscription", "params": {"channel": "deribit_price_index.btc_usd", "data": {"price": 60000.5}}}), line(1.2, {"method": "subscription", "params": {"channel": "deribit_volatility_index.eth_usd", "data": {"volatility": 55}}}), line(1.3, {"method": "test"})]
    for venue, rows in (("polymarket", poly), ("deribit", index)):
        (tmp_path / venue / "2026-10-01").mkdir(parents=True)
        (tmp_path / venue / "2026-10-01" / "10.jsonl.gz").write_bytes(gzip.compress(("\n".join(rows) + "\n").encode()))
    many = ("\n".join(line(float(k), {"event_type": "last_trade_price", "asset_id": "t", "price": "0.5", "size": k}) for k in range(40_000)) + "\n").encode()
    cut = gzip.compress(many, 1)
    (tmp_path / "polymarket" / "2026-10-01" / "11.jsonl.gz").write_bytes(cut[: len(cut) * 2 // 3])
    rows = nested.recorded(spark, f"{tmp_path}/*/*/*.jsonl.gz")
    whole = rows.where(~F.col("file").endswith("11.jsonl.gz"))
    got = [tuple(r)[:1] + (r.t, r.kind, r.name, r.bid, r.ask, r.price, r.size, r.side) for r in nested.market_updates(whole).orderBy("venue", "t", "at", "nth").collect()]
    assert got == [
        ("deribit", 1.0, "index", "BTC", None, None, 60000.5, None, None), ("deribit", 1.2, "volatility", "ETH", None, None, 55.0, None, None),
        ("polymarket", 1.5, "quote", "7", 0.45, 0.5, None, None, None), ("polymarket", 2.0, "quote", "7", 0.41, 0.52, None, None, None), ("polymarket", 2.5, "trade", "7", None, None, 0.5, 0.0, "BUY"), ("polymarket", 3.5, "quote", "6", None, None, None, None, None),
    ]
    told = {r.file.rsplit("/", 1)[-1]: (r.lines, r.bad) for r in nested.unreadable(whole.where("venue = 'polymarket'")).collect()}
    assert told == {"10.jsonl.gz": (8, 3)}
    tail = nested.market_updates(rows.where(F.col("file").endswith("11.jsonl.gz"))).agg(F.count("*"), F.max("size")).first()
    assert 10_000 < tail[0] < 40_000 and tail[1] == tail[0] - 1
