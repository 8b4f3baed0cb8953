"""The regime and the rules against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest

from tidegrid.operators.folds import view
from tidegrid.plans import gauntlet as G

NAMES = ["spy", "qqq", "vix", "vix3m", "us10y", "us3m", "dxy", "tlt"]
DAYS = pd.date_range("2022-01-03", periods=260, freq="B").date


def market(seed, missing=()):
    rng = np.random.default_rng(seed)
    walk = lambda a, s, n=260: a * np.exp(np.cumsum(rng.normal(0, s, n)))
    out = pd.DataFrame({"spy": walk(400, 0.02), "qqq": walk(300, 0.02), "vix": walk(20, 0.09), "vix3m": walk(21, 0.05), "us10y": 2 + np.cumsum(rng.normal(0, 0.1, 260)), "us3m": 2 + np.cumsum(rng.normal(0, 0.1, 260)), "dxy": walk(100, 0.006), "tlt": walk(110, 0.01)})
    out[list(missing)] = np.nan
    return out


def clip(x):
    return max(-1.0, min(1.0, x))


def trend(x):
    score, now, was = 0.0, x[-20:], x[-40:-20]
    for n, w in ((200, 0.5), (50, 0.25)):
        if len(x) >= n:
            score += w if x[-1] > np.mean(x[-n:]) else -w
    if len(x) >= 40:
        if min(now) < min(was) and max(now) < max(was):
            score -= 0.25
        elif min(now) > min(was) and max(now) > max(was):
            score += 0.25
    return clip(score)


def plain(table, earnings_yield=None):
    """The last row's assessment."""
    x = {c: table[c].to_numpy() for c in table if table[c].notna().all()}
    n, parts = len(table), {"trend_spy": trend(x["spy"]), "trend_qqq": trend(x["qqq"])}
    vix = x["vix"][-1]
    score = next((s for bound, s in ((15, 1.0), (20, 0.5), (25, 0.0), (30, -0.5)) if vix < bound), -1.0)
    parts["vix_level"] = clip(score - 0.5) if n > 6 and vix / x["vix"][-6] - 1 > 0.25 else score
    if "vix3m" in x:
        ratio = vix / x["vix3m"][-1]
        parts["vix_term"] = 1.0 if ratio < 0.85 else 0.5 if ratio < 0.95 else 0.0 if ratio <= 1 else -0.5 if ratio <= 1.1 else -1.0
    if "us10y" in x and "us3m" in x:
        gap = x["us10y"] - x["us3m"]
        now, then = gap[-1], gap[-21] if n > 21 else gap[-1]
        score = 0.5 if now > 1 else 0.25 if now > 0.25 else 0.0 if now >= 0 else -0.25 if now > -0.5 else -0.5
        parts["yield_curve"] = clip(score - 0.25) if then < 0 and now - then > 0.4 else score
    if "dxy" in x and n >= 22:
        parts["dollar"] = clip(-(x["dxy"][-1] / x["dxy"][-21] - 1) / 0.03)
    bonds = []
    if earnings_yield is not None and "us10y" in x:
        bonds.append(clip((earnings_yield - x["us10y"][-1] / 100) / 0.02))
    if "tlt" in x and n >= 22:
        bonds.append(clip(((x["spy"][-1] / x["spy"][-21]) / (x["tlt"][-1] / x["tlt"][-21]) - 1) / 0.05))
    if bonds:
        parts["bonds"] = sum(bonds) / len(bonds)
    weight = {"trend_spy": 0.2, "trend_qqq": 0.2, "bonds": 0.1}
    total = sum(weight.get(k, 0.15) for k in parts)
    composite = round(sum(v * weight.get(k, 0.15) for k, v in parts.items()) / total, 9)
    regime = "RISK_ON" if composite > 0.2 else "RISK_OFF" if composite < -0.2 else "NEUTRAL"
    near = (lambda v: abs(v) <= 0.25) if regime == "NEUTRAL" else (lambda v: np.sign(v) == np.sign(composite))
    agreement = sum(weight.get(k, 0.15) for k, v in parts.items() if near(v)) / total
    return parts, composite, min(1.0, 0.5 * min(1.0, abs(composite) / 0.6) + 0.5 * agreement) * (0.8 if len(parts) < 5 else 1.0), regime


@pytest.mark.parametrize(("seed", "missing", "earnings"), [(1, (), None), (2, (), 0.045), (3, ("vix3m", "dxy"), None), (4, ("vix3m", "us3m", "dxy", "tlt"), None)])
def test_regime(spark, seed, missing, earnings):
    table = market(seed, missing)
    rows = [(DAYS[i], *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(table[NAMES].to_numpy())]
    spark.createDataFrame(rows, "t date, " + ", ".join(f"{n} double" for n in NAMES)).createOrReplaceTempView("test_market")
    got = {r.t: r for r in view(spark, "", "SELECT * FROM regime_", {"market_": "SELECT * FROM test_market"} | G.regime(earnings)).collect()}
    seen = set()
    for n in (3, 10, 22, 30, 45, 60, 120, 199, 200, 230, 260):
        parts, composite, confidence, regime = plain(table[:n], earnings)
        row = got[DAYS[n - 1]]
        assert {k: row[k] for k in G.WEIGHTS if row[k] is not None} == pytest.approx(parts), n
        assert (row.parts, row.regime) == (len(parts), regime) and np.allclose([row.composite, row.confidence], [composite, confidence], atol=1e-8)
        seen.add(regime)
    assert len(seen) > 1


GOOD = {"direction": "long", "entry": 100.0, "stop": 95.0, "target": 120.0, "levels": [99.0, 130.0], "reasons": ["technical", "fundamental", "flow"], "catalyst": "earnings beat", "adv": 5e7, "next": 40, "holding": None, "defensive": False, "conviction": "medium", "regime": "RISK_ON"}
CASES = {
    "passes": ({}, "", 20),
    "poor reward": ({"target": 110.0}, "1", 20),
    "exactly three": ({"target": 115.0}, "", 20),
    "wall on the way": ({"levels": [110.0]}, "1", 20),
    "wall far enough": ({"levels": [116.0]}, "", 20),
    "stop above a long's entry": ({"stop": 105.0}, "15", None),
    "no stop": ({"stop": None}, "15", None),
    "two signals": ({"reasons": ["technical", "flow"]}, "2", 20),
    "three of two kinds": ({"reasons": ["technical", "flow", "flow"]}, "2", 20),
    "no reasons": ({"reasons": []}, "2", 20),
    "against the tide": ({"regime": "RISK_OFF"}, "3", 20),
    "defensive against the tide": ({"regime": "RISK_OFF", "defensive": True, "conviction": "high"}, "", 20),
    "neutral": ({"regime": "NEUTRAL"}, "", 20),
    "no regime": ({"regime": None}, "3", 20),
    "thin": ({"adv": 1e7}, "4", 20),
    "volume unknown": ({"adv": None}, "4", 20),
    "no catalyst": ({"catalyst": "  "}, "4", 20),
    "earnings soon": ({"next": 11}, "4", 20),
    "earnings after": ({"next": 12}, "", 20),
    "earnings past": ({"next": -1}, "", 20),
    "held longer": ({"next": 12, "holding": 15}, "4", 20),
    "earnings unknown": ({"next": None}, "", 20),
    "one share breaks the rule": ({"entry": 2000.0, "stop": 1800.0, "target": 3000.0}, "5", None),
    "leverage": ({"entry": 100.0, "stop": 99.5, "target": 120.0}, "5", None),
    "short": ({"direction": "short", "stop": 105.0, "target": 80.0, "levels": [81.0], "regime": "RISK_OFF"}, "", 20),
    "short with support near": ({"direction": "short", "stop": 105.0, "target": 80.0, "levels": [90.0], "regime": "RISK_OFF"}, "1", 20),
    "short against the tide": ({"direction": "short", "stop": 105.0, "target": 80.0, "levels": []}, "3", 20),
}


def test_rules(spark):
    day, rows, levels, reasons, regimes = pd.Timestamp("2024-05-01"), [], [], [], []
    for i, (name, (change, _, _)) in enumerate(CASES.items()):
        c = GOOD | change
        on = (day + pd.Timedelta(days=i)).date()
        rows.append((name, on, c["direction"], c["entry"], c["stop"], c["target"], c["catalyst"], c["adv"], None if c["next"] is None else on + pd.Timedelta(days=c["next"]), c["holding"], c["defensive"], c["conviction"]))
        levels += [(name, v) for v in c["levels"]]
        reasons += [(name, v) for v in c["reasons"]]
        regimes += [(on, c["regime"])] if c["regime"] else []
    for name, data, schema in (
        ("candidate", rows, "id string, day date, direction string, entry double, stop double, target double, catalyst string, avg_dollar_volume double, next_earnings date, holding_days int, defensive boolean, conviction string"),
        ("level", levels, "id string, level double"), ("reason", reasons, "id string, category string"), ("regime", regimes, "t date, regime string"),
    ):
        spark.createDataFrame(data, schema).createOrReplaceTempView(f"test_{name}")
    got = {r.id: r for r in view(spark, "", "SELECT * FROM verdict_", {f"{n}_": f"SELECT * FROM test_{n}" for n in ("candidate", "level", "reason", "regime")} | G.gauntlet()).collect()}
    for name, (_, failed, shares) in CASES.items():
        row = got[name]
        assert "".join(str(k) for k in range(1, 6) if not row[f"r{k}"]) == failed, name
        assert row.shares == (None if shares is None else shares) and row.verdict == ("ABORT" if failed else "TAKE"), name
    assert math.floor(10_000 * 0.01 / 5) == 20


def test_equal_but_for_rounding(spark):
    """A sum of hundredths that equals its mean is not above it, whichever way the two were added up; nor is a close below its own."""
    from tidegrid.catalog import SPARK_VIEWS

    up, down = 0.1 + 0.2, 0.3
    setup = f"SELECT name AS symbol, DATE '2024-01-01' AS t, 0.5 AS close, 0.6 AS high, 0.4 AS low, CAST(NULL AS DOUBLE) AS r, volume, funding, 2 AS trades, mean, usual, 1.0 AS adv, CAST(NULL AS DOUBLE) AS top, CAST(NULL AS DOUBLE) AS bottom, paid FROM VALUES ('tie', {up!r}, {up!r}, {down!r}, {down!r}, {0.5 + 1e-15!r}), ('above', 0.31D, 0.31D, {down!r}, {down!r}, 0.49D) AS v(name, volume, funding, usual, paid, mean)"
    views = {"setup_": setup} | G.CANDIDATES | SPARK_VIEWS["rule_five"] | {"setup_": setup}
    assert up > down
    got = {(r.symbol, r.category) for r in view(spark, "", "SELECT d.symbol, s.category FROM reason_ s JOIN drawn_ d ON d.id = s.id", views).collect()}
    assert got == {("above", "flow"), ("above", "fundamental")}
    assert {r.direction for r in view(spark, "", "SELECT direction FROM drawn_", views).collect()} == {"long"}


def test_margin_follows_the_scale(spark):
    """Small prices and sums are told apart, large sums still tie; what is infinite is not above itself, nor below."""
    from tidegrid.catalog import SPARK_VIEWS

    cases = {  # close, mean, volume, usual, funding, paid
        "small above": (3e-10, 2e-10, 3e-10, 2e-10, 3e-10, 2e-10), "small below": (1e-10, 2e-10, 1e-10, 2e-10, 1e-10, 2e-10),
        "large tie": (1e6 - 1e-7, 1e6, 1e6 + 1e-7, 1e6, 1e6 + 1e-7, 1e6), "large above": (1e6 + 0.01, 1e6, 1e6 + 0.01, 1e6, 1e6 + 0.01, 1e6), "infinite": (math.inf,) * 6,
    }
    values = ", ".join(f"('{name}', " + ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in case) + ")" for name, case in cases.items())
    setup = f"SELECT name AS symbol, DATE '2024-01-01' AS t, close, 0.6 AS high, 0.4 AS low, CAST(NULL AS DOUBLE) AS r, volume, funding, 2 AS trades, mean, usual, 1.0 AS adv, CAST(NULL AS DOUBLE) AS top, CAST(NULL AS DOUBLE) AS bottom, paid FROM VALUES {values} AS v(name, close, mean, volume, usual, funding, paid)"
    views = G.CANDIDATES | SPARK_VIEWS["rule_five"] | {"setup_": setup}
    got = {(r.symbol, r.category) for r in view(spark, "", "SELECT d.symbol, s.category FROM reason_ s JOIN drawn_ d ON d.id = s.id", views).collect()}
    assert got == {(name, kind) for name in ("small above", "large above") for kind in ("flow", "fundamental")}
    got = {r.symbol: (r.direction, r.catalyst) for r in view(spark, "", "SELECT d.symbol, c.direction, c.catalyst FROM candidate_ c JOIN drawn_ d ON d.id = c.id", views).collect()}
    assert got == {"small above": ("long", "volume"), "small below": ("short", " "), "large tie": ("long", "volume"), "large above": ("long", "volume"), "infinite": ("long", " ")}
