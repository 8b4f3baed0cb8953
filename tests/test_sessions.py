"""Session splits, rolling ranks, setups, fades and CSV bars against plain Python."""

import numpy as np
import pandas as pd
import pytest

from tidegrid.operators import folds
from tidegrid.operators.folds import view
from tidegrid.plans import sessions
from tidegrid.sources import vendor


def test_session_split(spark):
    rows = []
    add = lambda day, times: rows.extend((("q", pd.Timestamp(f"{day} {t}").to_pydatetime(), o, c, 10.0)) for t, o, c in times)
    add("2024-03-01", [("09:29", 1.0, 1.0), ("09:30", 100.0, 101.0), ("15:29", 103.0, 104.0), ("15:30", 104.0, 105.0), ("16:00", 106.0, 90.0), ("16:01", 1.0, 1.0)])
    add("2024-03-04", [("09:30", 200.0, 201.0), ("12:59", 202.0, 203.0)])  # an early close
    add("2024-03-05", [("09:31", 110.0, 111.0), ("15:00", 112.0, 113.0), ("15:44", 114.0, 115.0)])  # no minute late enough
    add("2024-03-06", [("10:00", 120.0, 121.0), ("15:59", 122.0, 123.0)])
    add("2024-03-07", [("15:45", 122.0, 123.0)])  # nothing before the decision
    spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, close double, volume double").createOrReplaceTempView("test_minutes")
    got = [(str(r.day), r.is_late, round(r.open, 9), round(r.close, 9), r.ret_to_decision) for r in view(spark, "", "SELECT * FROM split_ ORDER BY day, is_late", {"minutes_": "SELECT * FROM test_minutes"} | sessions.session_split()).collect()]
    want = [("2024-03-01", 0, 100.0, 104.0, 104 / 100 - 1), ("2024-03-01", 1, 104.0, 106.0, None), ("2024-03-06", 0, 106.0, 106 * 121 / 120, 121 / 120 - 1), ("2024-03-06", 1, 106 * 121 / 120, 106 * 123 / 120, None)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:4] for g in got], [w[2:4] for w in want])
    assert [g[4] is None for g in got] == [w[4] is None for w in want] and np.isclose(got[2][4], want[2][4])


def test_rolling_rank(spark):
    rng, days = np.random.default_rng(1), pd.date_range("2019-01-07", periods=200, freq="7D")
    funding = np.round(rng.normal(0, 1, 200), 0)  # many ties
    funding[50:53] = np.nan
    rows = [("a", d.date(), None if np.isnan(v) else float(v)) for d, v in zip(days, funding, strict=True)]
    spark.createDataFrame(rows, "symbol string, t date, funding double").createOrReplaceTempView("test_funding")
    got = view(spark, "", "SELECT * FROM ranked_ ORDER BY t", {"panel_1w": "SELECT * FROM test_funding"} | sessions.rolling_rank(12, 4, 0.8, 3)).toPandas()
    score = pd.Series(funding, days).rolling(3, min_periods=3).mean().round(12)
    marks = days.month != np.r_[0, days.month[:-1]]
    pct = score[marks].rolling(12, min_periods=4).rank(pct=True).reindex(days).ffill()
    assert np.allclose(got.pct.to_numpy(float), pct.to_numpy(), equal_nan=True) and (got.hot.to_numpy() == (pct > 0.8).to_numpy()).all() and got.hot.any()


def test_rsi_setup():
    n = 60
    close = np.concatenate([np.linspace(100, 130, 40), [120, 110, 100], np.linspace(101, 120, 17)])
    volume = np.full(n, 10.0)
    volume[40:43] = 30.0
    g = pd.DataFrame({"symbol": "a", "t": range(n), "close": close, "volume": volume})
    out = folds.rsi_setup(most=50.0)(g)
    assert np.flatnonzero(out.fired).tolist() == [42] and np.flatnonzero(out.held).tolist() == [42, 43, 44, 45, 46]
    g.loc[41, "volume"] = 1.0
    assert not folds.rsi_setup(most=50.0)(g).fired.any()


def test_fade_holds_one_at_a_time():
    z = [0, 2, 2, 0, 3, 0, 0, 1.5, np.nan, 9]
    out = folds.fade(1.5, 3)(pd.DataFrame({"symbol": "a", "t": range(10), "z": z}))
    assert out.side.tolist() == [0, -1, -1, -1, -1, -1, -1, -1, -1, -1]
    out = folds.fade(2.5, 2)(pd.DataFrame({"symbol": "a", "t": range(10), "z": z}))
    assert out.side.tolist() == [0, 0, 0, 0, -1, -1, 0, 0, 0, -1]


def test_csv_bars(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\r\n2024-01-03,1,2,0.5,1.5,10\r\n2024-01-02,1,2,0.5,,10\r\n2024-01-03 00:00:00,9,9,9,9,90\r\n")
    (tmp_path / "bbb.csv").write_text('"date","VOLUME","adj close","low","high","open"\n2024-01-02,5,7,6,8,"6.5"\nnot a day,1,1,1,1,1\n2024-01-04,x,7.5,6,8,6\n')
    got = sorted((r.symbol, str(r.day), r.open, r.high, r.low, r.close, r.volume) for r in vendor.ohlcv_csv(spark, str(tmp_path)).collect())
    assert got[:2] == [("AAA", "2024-01-03", 9.0, 9.0, 9.0, 9.0, 90.0), ("bbb", "2024-01-02", 6.5, 8.0, 6.0, 7.0, 5.0)] and got[2][:6] == ("bbb", "2024-01-04", 6.0, 8.0, 6.0, 7.5) and got[2][6] is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "C.csv").write_text("Date,Open,Close\n2024-01-02,1,2\n")
    with pytest.raises(Exception, match="columns missing in C: high, low, volume"):
        vendor.ohlcv_csv(spark, str(tmp_path / "bad")).collect()
