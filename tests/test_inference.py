"""Resampling plans against plain numpy on hand-made panels."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from tidegrid.operators.folds import view
from tidegrid.plans import inference

FIELDS = ["open", "high", "low", "quote_volume", "volume", "trades", "funding"]


def panel(seed=1, n=60, gaps=True):
    """Three symbols: one whole, one listed late and ended early, one with holes."""
    rng, rows = np.random.default_rng(seed), []
    days = pd.date_range("2020-01-06", periods=n, freq="7D").date
    for k, s in enumerate("abc"):
        price = 100 * np.exp(np.cumsum(rng.normal(0.01 * (k - 1), 0.05, n)))
        for j in range(n):
            gone = gaps and ((s == "b" and not 7 <= j < n - 5) or (s == "c" and j in (3, 20, 21, 40)))
            rows.append((s, days[j], *([None] * 8 if gone else [price[j], price[j] * 0.99, price[j] * 1.02, price[j] * 0.97, price[j] * (5 + j), 5.0 + j, 10 + j, 0.001 * j])))
    return pd.DataFrame(rows, columns=["symbol", "t", "close", *FIELDS]).astype({"trades": "float"})


def run(spark, name, table, body, views):
    spark.createDataFrame(table).selectExpr(*(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c not in ("symbol", "t") else c for c in table.columns)).createOrReplaceTempView(name)
    return view(spark, "", body, views | {"panel_1w": f"SELECT * FROM {name}"}).toPandas()


def orders(draw, n, symbol=None):
    """Source of each bar 1 .. n - 1."""
    key = lambda j: hashlib.md5((f"{draw}:{j}" if symbol is None else f"{draw}:{symbol}:{j}").encode()).hexdigest()
    return dict(zip(range(1, n), sorted(range(1, n), key=lambda j: (key(j), j)), strict=True))


def rebuild(table, draw, same=True, keep=False):
    out = {}
    n = table.t.nunique()
    for s, g in table.groupby("symbol"):
        g = g.sort_values("t").reset_index(drop=True)
        x = g.close.pct_change(fill_method=None).to_numpy()
        live = [j for j in range(1, n) if np.isfinite(x[j])]
        order, source = orders(draw, n, None if same else s), {}
        for j in live:
            if order[j] in live:
                source[j] = order[j]
        spare = [j for j in live if j not in set(source.values())]
        for j in live:
            if j not in source:
                source[j] = spare.pop(0)
        assert sorted(source.values()) == live
        step = np.zeros(n)
        if keep:
            sigma = g.close.pct_change(fill_method=None).rolling(30, min_periods=5, center=True).std().bfill().ffill().to_numpy()
            mu = np.nanmean(x)
            for j, k in source.items():
                step[j] = np.clip(mu + sigma[j] * (x[k] - mu) / sigma[k], np.nanmin(x), np.nanmax(x))
        else:
            for j, k in source.items():
                step[j] = x[k]
        close = np.where(g.close.notna(), g.close.dropna().iloc[0] * np.cumprod(1 + step), np.nan)
        from_ = np.array([source.get(j, j) for j in range(n)])
        for j in range(n):
            if close[j] == close[j]:
                at = from_[j]
                out[s, j] = [close[j], *(close[j] * g[f][at] / g.close[at] for f in FIELDS[:4]), *(g[f][at] for f in FIELDS[4:])]
    return out


@pytest.mark.parametrize("how", [{}, {"same": False}, {"keep_volatility": True}])
def test_permuted_panel(spark, how):
    table = panel()
    got = run(spark, "test_panel", table, "SELECT * FROM permuted_ WHERE close IS NOT NULL", inference.permuted(20, **how))
    for draw, rows in got.groupby("draw"):
        want = rebuild(table, draw, how.get("same", True), how.get("keep_volatility", False))
        have = {(r.symbol, r.j): [r.close, *(getattr(r, f) for f in FIELDS)] for r in rows.itertuples()}
        assert have.keys() == want.keys() and np.allclose([have[k] for k in sorted(have)], [want[k] for k in sorted(have)])
    assert got.draw.nunique() == 20


def test_returns_are_reordered_not_changed(spark):
    table = panel(gaps=False)
    got = run(spark, "test_whole", table, "SELECT draw, symbol, j, close FROM permuted_", inference.permuted(3))
    was = {s: np.sort(g.sort_values("t").close.pct_change().dropna()) for s, g in table.groupby("symbol")}
    moves = {}
    for (draw, s), g in got.groupby(["draw", "symbol"]):
        x = g.sort_values("j").close.pct_change().dropna().to_numpy()
        assert np.allclose(np.sort(x), was[s])
        moves[draw, s] = x
    known = {s: g.sort_values("t").close.pct_change().dropna().to_numpy() for s, g in table.groupby("symbol")}
    assert all(np.isclose(np.corrcoef(moves[d, "a"], moves[d, "b"])[0, 1], np.corrcoef(known["a"], known["b"])[0, 1]) for d in range(3))  # one order keeps co-movement


def trending(seed, drift):
    """Symbols whose direction persists for 20 bars (drift) or not at all."""
    rng, rows = np.random.default_rng(seed), []
    days = pd.date_range("2015-01-05", periods=240, freq="7D").date
    for s in "abcdef":
        way = np.repeat(rng.choice([-1.0, 1.0], 12), 20) * drift
        price = 100 * np.exp(np.cumsum(way + rng.normal(0, 0.02, 240)))
        rows += [(s, days[j], price[j], *[price[j]] * 4, 1.0, 1.0, 0.0) for j in range(240)]
    return pd.DataFrame(rows, columns=["symbol", "t", "close", *FIELDS])


def test_bar_permutation_tells_timing_from_noise(spark):
    body, views = inference.bar_permutation_test(30)
    found = run(spark, "test_trend", trending(1, 0.02), body, views).iloc[0]
    assert found.p_value == round(1 / 31, 6) and found.verdict == "PASS" and found.percentile == 100 and found.observed > found.null_95th
    null = run(spark, "test_noise", trending(2, 0.0), body, views).iloc[0]
    assert null.p_value > 0.05 and null.permutations == 30


def politis_white(x):
    n, d = len(x), x - x.mean()
    quiet, top = 5, int(np.ceil(np.sqrt(n))) + 5
    c = np.array([(d[k:] * d[: n - k]).sum() / n for k in range(top + 1)])
    small = np.abs(c / c[0]) < 2 * np.sqrt(np.log10(n) / n)
    last = next((m for m in range(top - quiet + 1) if small[m + 1 : m + quiet + 1].all()), None)
    m = top if last is None else min(2 * max(last, 1), top)
    lam = lambda k: 1.0 if 2 * k <= m else 2 * (1 - k / m)
    g = sum(2 * lam(k) * k * c[k] for k in range(1, m + 1))
    v = c[0] + sum(2 * lam(k) * c[k] for k in range(1, m + 1))
    return max(1.0, min((2 * g * g / (2 * v * v)) ** (1 / 3) * n ** (1 / 3), np.ceil(min(3 * np.sqrt(n), n / 3))))


def ar(seed, n, rho):
    e, x = np.random.default_rng(seed).normal(0.002, 0.03, n), np.zeros(n)
    for i in range(n):
        x[i] = rho * (x[i - 1] if i else 0) + e[i]
    return x


def test_bootstrap_interval(spark):
    series = {"calm": ar(1, 300, 0.0), "slow": ar(2, 300, 0.85), "mid": ar(3, 77, 0.4), "short": ar(4, 15, 0.0), "flat": np.zeros(40)}
    days = pd.date_range("2015-01-05", periods=302, freq="7D").date
    rows = [(s, days[j], float(x)) for s, v in series.items() for j, x in enumerate(v)]
    spark.createDataFrame(rows, "symbol string, t date, r double").createOrReplaceTempView("test_returns")
    body, views = inference.bootstrap_ci(120)
    got = {r.symbol: r for r in view(spark, "", body, views | {"ret_1w": "SELECT * FROM test_returns"}).collect()}
    u = lambda k, i, a: int(hashlib.md5(f"{k}:{i}".encode()).hexdigest()[a : a + 8], 16) / 2**32
    for s, x in series.items():
        if s in ("short", "flat"):
            assert got[s].lower is None and got[s].upper is None
            continue
        n, block, drawn = len(x), politis_white(x), []
        assert np.isclose(got[s].block, block, atol=1e-6)
        for k in range(120):
            at, start = [], 0
            for i in range(n):
                start = int(np.floor(u(k, i, 8) * n)) if i == 0 or u(k, i, 0) < 1 / block else (start + 1) % n
                at.append(start)
            y = x[at]
            drawn.append(y.mean() / y.std(ddof=1) * np.sqrt(52))
        assert np.allclose([got[s].lower, got[s].upper], np.percentile(drawn, [2.5, 97.5]), atol=1e-5)
    assert got["slow"].block > 2 * got["calm"].block


def returns(spark, columns):
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for k, x in columns.items() for i, v in enumerate(x)], "symbol string, i long, r double")


def test_step_down_against_a_loop(spark):
    from tidegrid.operators import selection

    rng = np.random.default_rng(3)
    columns = {f"n{k}": rng.normal(0, 1, 250) for k in range(12)} | {"big": rng.normal(0.6, 1, 250), "mid": rng.normal(0.28, 1, 250), "small": rng.normal(0.19, 1, 250)}
    null = selection.studentised(returns(spark, columns), 300)
    table = null.toPandas().pivot(index="draw", columns="symbol", values="z")
    own = null.select("symbol", "statistic").distinct().toPandas().set_index("symbol").statistic
    left, step, want = list(table.columns), 0, {}
    while left:
        step += 1
        critical = np.quantile(table[left].max(axis=1), 0.95)
        gone = [s for s in left if own[s] > critical]
        if not gone:
            break
        want |= {s: (step, critical) for s in gone}
        left = [s for s in left if s not in gone]
    got = {r.symbol: r for r in selection.step_down(null).collect()}
    assert {s: r.step for s, r in got.items() if r.step} == {s: k for s, (k, _) in want.items()} and "big" in want and len(got) == 15
    assert all(np.isclose(got[s].critical, c) for s, (_, c) in want.items()) and not any(s.startswith("n") for s in want)


def test_effective_trials(spark):
    from tidegrid.operators import selection

    rng = np.random.default_rng(4)
    one = rng.normal(0, 1, 128)
    walsh = np.array([[(-1) ** bin(a & b).count("1") for b in range(128)] for a in range(1, 9)], float)
    rank = lambda c: selection.effective_trials(returns(spark, c)).first()
    same = rank({f"v{k}": one * (k + 1) for k in range(6)})
    apart = rank({f"v{k}": x for k, x in enumerate(walsh)})
    assert (same.effective, same.raw) == (1, 6) and np.isclose(same.entropy_rank, 1) and apart.effective == 8 and np.isclose(apart.entropy_rank, 8)
    common = rng.normal(0, 1, 40)
    for variants in (9, 60):  # fewer and more variants than bars
        mixed = {f"v{k:02d}": list(0.7 * common + rng.normal(0, 1, 40)) for k in range(variants)}
        mixed["v00"][5] = mixed["v01"][39] = None
        frame = pd.DataFrame(mixed).astype(float).fillna(0.0)
        values = np.linalg.eigvalsh(frame.corr().to_numpy())
        share = values[values > 1e-12] / values[values > 1e-12].sum()
        found = rank(mixed | {"none": [None] * 40})
        assert np.isclose(found.entropy_rank, np.exp(-(share * np.log(share)).sum())) and found.raw == variants
    assert rank({"only": one}).effective == 1
