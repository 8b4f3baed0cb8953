"""Regressions, pairs and curves against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest

from tidegrid.operators import regression
from tidegrid.operators.folds import view
from tidegrid.plans import spreads

DAYS = pd.date_range("2018-01-01", periods=220, freq="7D").date


def newey_west(y, x, lags=None):
    d = np.column_stack([np.ones(len(y)), x])
    n, k = d.shape
    lags = math.floor(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    beta = np.linalg.solve(d.T @ d, d.T @ y)
    e = y - d @ beta
    u = d * e[:, None]
    s = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    bread = np.linalg.inv(d.T @ d)
    return beta, np.sqrt(np.diag(bread @ s @ bread) * n / (n - k)), 1 - e @ e / ((y - y.mean()) ** 2).sum(), beta[0] / e.std(ddof=1) * np.sqrt(52)


@pytest.mark.parametrize("lags", [None, 0, 9])
def test_ols_hac(spark, lags):
    rng, rows, want = np.random.default_rng(1), [], {}
    for s, n in (("a", 220), ("b", 57), ("few", 12)):
        x = rng.normal(0, 1, (n, 3))
        noise = np.convolve(rng.normal(0, 1, n + 3), [1, 0.7, 0.4, 0.2], "valid")
        y = 0.1 + x @ [1.5, -0.4, 0.0] + noise
        want[s] = newey_west(y, x, lags)
        rows += [(s, DAYS[i], float(y[i]), *map(float, x[i])) for i in range(n)]
    rows += [("a", DAYS[0], None, 1.0, 1.0, 1.0), ("b", DAYS[0], 1.0, None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "symbol string, t date, y double, f double, g double, h double")
    got = regression.ols_hac(table, ["f", "g", "h"], lags=lags).toPandas()
    assert set(got.symbol) == {"a", "b"}
    for s in "ab":
        mine = got[got.symbol == s].set_index("term").loc[["alpha", "f", "g", "h"]]
        beta, se, r2, ratio = want[s]
        assert np.allclose(mine.estimate, beta) and np.allclose(mine.se, se) and np.allclose(mine.t_stat, beta / se)
        assert np.allclose(mine.r_squared, r2) and np.allclose(mine.information_ratio, ratio)
        assert np.allclose(mine.p_value, [math.erfc(abs(t) / math.sqrt(2)) for t in beta / se])


def forecast_rows(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for day in pd.date_range("2020-01-01", "2021-06-30", freq="D").date:
        for s in "ab":
            x = rng.normal(0, 1, 3)
            rows.append((s, day, *map(float, x), float(0.5 + x @ [1.0, -2.0, 0.1] + rng.normal(0, 1))))
    return pd.DataFrame(rows, columns=["symbol", "t", "p", "q", "r", "y"])


def test_walk_forward_equals_closed_form(spark):
    table = forecast_rows()
    table.loc[5, "p"] = np.nan
    got = regression.walk_forward_ridge(spark.createDataFrame(table).selectExpr("symbol", "t", "CASE WHEN isnan(p) THEN NULL ELSE p END AS p", "q", "r", "y"), ["p", "q", "r"], penalty=3.0, purge_days=7).toPandas()
    table = table.dropna()
    for fold, part in got.groupby("fold"):
        train = table[pd.to_datetime(table.t) <= pd.Timestamp(fold) - pd.Timedelta(days=8)]
        assert len(train) >= 250
        x, y = train[["p", "q", "r"]].to_numpy(), train.y.to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        b = np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y - y.mean()))
        test = (part[["p", "q", "r"]].to_numpy() - x.mean(0)) / x.std(0)
        assert np.allclose(part.pred, y.mean() + test @ b) and np.allclose(part.base, y.mean())
    months = pd.to_datetime(table.t).dt.to_period("M")
    assert len(got) == sum(n for m, n in months.value_counts().items() if (pd.to_datetime(table.t) <= m.to_timestamp() - pd.Timedelta(days=8)).sum() >= 250)


def test_no_fold_sees_later_rows(spark):
    """What changes within the purge or later leaves earlier forecasts as they were."""
    table, leak = forecast_rows(), forecast_rows()
    late = pd.to_datetime(leak.t) > pd.Timestamp("2021-02-20")  # the fold of March fits on days up to 21 February
    leak.loc[late, "y"] = 1e6
    a, b = (regression.walk_forward_ridge(spark.createDataFrame(x), ["p", "q", "r"], purge_days=7).select("symbol", "t", "pred").toPandas().set_index(["symbol", "t"]).pred for x in (table, leak))
    before = [i for i in a.index if pd.Timestamp(i[1]) < pd.Timestamp("2021-03-01")]
    after = [i for i in a.index if pd.Timestamp(i[1]) >= pd.Timestamp("2021-03-01")]
    assert len(before) > 100 and np.allclose(a[before], b[before]) and not np.allclose(a[after], b[after])


def closes(seed=3, n=160):
    rng = np.random.default_rng(seed)
    walk, out = np.cumsum(rng.normal(0, 0.05, n)), {}
    for k, s in enumerate("abcd"):
        spread = np.zeros(n)
        for i in range(1, n):
            spread[i] = 0.6 * spread[i - 1] + rng.normal(0, 0.03)
        out[s] = np.exp(4 + (0.6 + 0.4 * k) * walk + spread)
    out["e"] = np.exp(np.cumsum(rng.normal(0, 0.05, n)))
    out["b"][100] = out["d"][10] = np.nan
    return pd.DataFrame(out)


def plain_scores(la, lb, lookback):
    beta, z, rhos = (np.full(len(la), np.nan) for _ in range(3))
    for t in range(lookback - 1, len(la)):
        x, y = lb[t - lookback + 1 : t + 1], la[t - lookback + 1 : t + 1]
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            continue
        b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        if not 0.25 <= b <= 4:
            continue
        s = y - b * x
        s0, s1 = s[:-1] - s[:-1].mean(), s[1:] - s[1:].mean()
        rho = rhos[t] = (s0 * s1).sum() / (s0 * s0).sum()
        if -1 < rho < 0.95 and (rho <= 0 or math.log(0.5) / math.log(rho) <= lookback / 2):
            beta[t], z[t] = b, (s[-1] - s.mean()) / s.std()
    return beta, z, rhos


def plain_sides(z, priced, entry, exit_z, most):
    state, held, out = 0.0, 0, []
    for v, ok in zip(z, priced, strict=True):
        if state:
            held += 1
            if (np.isfinite(v) and abs(v) <= exit_z) or held >= most or not ok:
                state, held = 0.0, 0
                out.append(0.0)
                continue
        elif np.isfinite(v):
            if v >= entry:
                state, held = -1.0, 0
            elif v <= -entry:
                state, held = 1.0, 0
        out.append(state)
    return np.array(out)


def test_pairs_against_a_loop(spark):
    table, lookback = closes(), 30
    n = len(table)
    rows = [(s, DAYS[i], None if np.isnan(v) else float(v)) for s in table for i, v in enumerate(table[s])]
    spark.createDataFrame(rows, "symbol string, t date, close double").createOrReplaceTempView("test_pairs")
    views = spreads.pair_zscores(lookback)[1] | {"panel_1w": "SELECT * FROM test_pairs"}
    scores = view(spark, "", "SELECT CAST(k AS INT) AS k, a, b, t, priced, beta, z, rho FROM pairs_z_", views).cache()
    got, book = scores.toPandas().sort_values(["k", "t"]), np.zeros((n, 5))
    sides, betas = {}, {}
    for k, (a, b) in enumerate(zip("abcd", "bcde", strict=True), 1):
        mine = got[got.k == k]
        la, lb = np.log(table[a].to_numpy()), np.log(table[b].to_numpy())
        beta, z, rho = plain_scores(la, lb, lookback)
        for name, want in (("beta", beta), ("z", z), ("rho", rho)):
            assert np.allclose(mine[name].to_numpy(float), want, equal_nan=True, atol=1e-7), name
        sides[k], betas[k] = plain_sides(z, np.isfinite(la) & np.isfinite(lb), 1.2, 0.4, 6), beta
    assert np.isfinite(betas[1]).sum() > 20
    for t in range(n):
        live = [k for k in sides if sides[k][t]][:2]
        for k in live:
            h = betas[k][t] if np.isfinite(betas[k][t]) else 1.0
            book[t, k - 1] += sides[k][t] / len(live) / (1 + h)
            book[t, k] -= sides[k][t] / len(live) * h / (1 + h)
        if np.abs(book[t]).sum():
            book[t] /= np.abs(book[t]).sum()
    found = regression.pair_book(scores, most=2, entry=1.2, exit_z=0.4, max_hold=6).toPandas()
    have = np.zeros((n, 5))
    for r in found.itertuples():
        have[DAYS.tolist().index(r.t), "abcde".index(r.symbol)] = r.w
    assert np.allclose(have, book, atol=1e-6) and (np.abs(book).sum(1) > 0).sum() > 20


def test_iv_curve_against_a_loop(spark):
    rng, quotes = np.random.default_rng(5), []
    t0 = pd.Timestamp("2024-01-01")
    for s in "ab":
        for d in (5, 20, 60, 200, -3) if s == "a" else (40,):
            for strike in (90.0, 95.0, 105.0, 120.0):
                quotes.append((s, t0.date(), (t0 + pd.Timedelta(days=d)).date(), strike, float(rng.uniform(0.2, 0.9))))
    quotes += [("a", t0.date(), (t0 + pd.Timedelta(days=20)).date(), 95.0, 0.5), ("a", t0.date(), (t0 + pd.Timedelta(days=20)).date(), 100.0, -1.0)]
    spark.createDataFrame(quotes, "symbol string, t date, expiry date, strike double, iv double").createOrReplaceTempView("test_quotes")
    spots = {"a": 100.0, "b": 96.0}
    spark.createDataFrame([(s, t0.date(), v) for s, v in spots.items()], "symbol string, t date, underlying double").createOrReplaceTempView("test_spots")
    tenors = (1, 5, 12, 20, 100, 200, 400)
    got = {(r.symbol, r.tenor): r.sigma for r in view(spark, "", "SELECT * FROM curve_", {"quotes_": "SELECT * FROM test_quotes", "spot_": "SELECT * FROM test_spots"} | spreads.iv_curve(tenors)).collect()}
    for s in "ab":
        near = {}
        for q in (q for q in quotes if q[0] == s and q[2] > q[1] and q[4] > 0):
            near.setdefault((q[2] - q[1]).days, []).append((abs(q[3] - spots[s]), q[4]))
        points = sorted((d / 365, np.mean([iv for far, iv in v if far == min(v)[0]])) for d, v in near.items())
        for tenor in tenors:
            tau = tenor / 365
            if tau <= points[0][0]:
                want = points[0][1]
            elif tau >= points[-1][0]:
                want = points[-1][1]
            else:
                want = math.sqrt(np.interp(tau, [p for p, _ in points], [p * v * v for p, v in points]) / tau)
            assert np.isclose(got[s, tenor], want), (s, tenor)


def test_iv_curve_reads_quotes_once(spark):
    from conftest import DATA
    from tidegrid.catalog import QUERIES

    plan = QUERIES["st_iv_curve"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3  # lineitem, part, orders
    t0, rng = pd.Timestamp("2024-01-01").date(), np.random.default_rng(6)
    quotes = [(s if s is None else str(s), t0, t0 + pd.Timedelta(days=int(d)), float(k), float(v)) for s, d, k, v in zip(rng.choice(["a", "b", None], 300), rng.integers(-20, 90, 300), rng.integers(80, 120, 300), rng.uniform(-0.1, 0.9, 300), strict=True)]
    quotes += [("a", t0, t0 + pd.Timedelta(days=9), None, 0.5), ("c", t0, t0 - pd.Timedelta(days=1), 1.0, 0.5)]
    spark.createDataFrame(quotes, "symbol string, t date, expiry date, strike double, iv double").createOrReplaceTempView("test_many_quotes")
    own = {"quotes_": "SELECT * FROM test_many_quotes", "spot_": spreads.CHAIN["spot_"]} | spreads.iv_curve((7, 30))
    one, two = ({(r.symbol, r.tenor): r.sigma for r in view(spark, "", "SELECT * FROM curve_", v).collect()} for v in (own, own | spreads.iv_curve_once((7, 30))))
    assert one.keys() == two.keys() == {(s, d) for s in "ab" for d in (7, 30)} and all(np.isclose(one[k], two[k]) for k in one)
