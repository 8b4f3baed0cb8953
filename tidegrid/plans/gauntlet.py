"""The seven-part market regime of every day, and the five rules that a trade candidate must pass.

Both are plain views, so a day's regime is one window over the calendar and a candidate's rules
are joins by its id: levels and reasons are tables with a row each, not lists in a cell.
"""

from __future__ import annotations

from .roster import r

# Weights of the components, bands of level (below the bound: the score), and limits of an account.
WEIGHTS = {"trend_spy": 0.20, "trend_qqq": 0.20, "vix_level": 0.15, "vix_term": 0.15, "yield_curve": 0.15, "dollar": 0.15, "bonds": 0.10}
VIX_BANDS = ((15.0, 1.0), (20.0, 0.5), (25.0, 0.0), (30.0, -0.5))
ACCOUNT = {"equity": 10_000.0, "risk": 0.01, "reward": 3.0, "signals": 3, "categories": 3, "volume": 20_000_000.0, "share": 0.01, "buffer": 1, "holding": 10}

DAY = "(ORDER BY t)"


def _rows(first: int, last: int = 0) -> str:
    return f"(ORDER BY t ROWS BETWEEN {first} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least({x}, 1.0), -1.0) END"  # least and greatest pass over nulls


def _trend(x: str) -> str:
    """Half for the 200-day mean, a quarter for the 50-day mean, a quarter for highs and lows against the 20 days before."""
    above = lambda n, w: f"CASE WHEN count({x}) OVER {_rows(n - 1)} = {n} THEN CASE WHEN {x} > avg({x}) OVER {_rows(n - 1)} THEN {w} ELSE -{w} END ELSE 0.0 END"
    now, was = _rows(19), _rows(39, 20)
    down = f"min({x}) OVER {now} < min({x}) OVER {was} AND max({x}) OVER {now} < max({x}) OVER {was}"
    up = f"min({x}) OVER {now} > min({x}) OVER {was} AND max({x}) OVER {now} > max({x}) OVER {was}"
    return f"CASE WHEN {x} IS NOT NULL THEN {above(200, 0.5)} + {above(50, 0.25)} + CASE WHEN n < 40 THEN 0.0 WHEN {down} THEN -0.25 WHEN {up} THEN 0.25 ELSE 0.0 END END"


def regime(earnings_yield: float | None = None) -> dict[str, str]:
    """Views up to `regime_` (t, the seven scores, parts, composite, confidence, regime), from market_: a row a day with
    spy, qqq, vix, vix3m, us10y, us3m, dxy, tlt, any of which may be null: its component is left out, and the
    composite is the weighted mean of the others. Scores lie in [-1, 1].

    earnings_yield: of stocks, as a fraction, compared with the ten-year yield."""
    level = " ".join(f"WHEN vix < {bound} THEN {score}" for bound, score in VIX_BANDS)
    spread = "us10y - us3m"
    then = f"CASE WHEN n > 21 THEN lag({spread}, 20) OVER {DAY} ELSE {spread} END"
    relative = f"{_clip(f'((spy / lag(spy, 20) OVER {DAY}) / (tlt / lag(tlt, 20) OVER {DAY}) - 1) / 0.05')}"
    yields = f"{_clip(f'({earnings_yield} - us10y / 100) / 0.02')}" if earnings_yield is not None else "CAST(NULL AS DOUBLE)"
    names = list(WEIGHTS)
    weigh = lambda what: " + ".join(what(n, w) for n, w in WEIGHTS.items())
    total = weigh(lambda n, w: f"CASE WHEN {n} IS NULL THEN 0.0 ELSE {w} END")
    agree = weigh(lambda n, w: f"CASE WHEN {n} IS NULL THEN 0.0 WHEN composite BETWEEN -0.2 AND 0.2 THEN CASE WHEN abs({n}) <= 0.25 THEN {w} ELSE 0.0 END WHEN sign({n}) = sign(composite) THEN {w} ELSE 0.0 END")
    return {
        "counted_": f"SELECT *, row_number() OVER {DAY} AS n FROM market_",
        "parts_": f"""SELECT t, {_trend('spy')} AS trend_spy, {_trend('qqq')} AS trend_qqq,
  CASE WHEN vix IS NOT NULL THEN {_clip(f"CASE {level} ELSE -1.0 END - CASE WHEN n > 6 AND vix / nullif(lag(vix, 5) OVER {DAY}, 0) - 1 > 0.25 THEN 0.5 ELSE 0.0 END")} END AS vix_level,
  CASE WHEN vix / vix3m < 0.85 THEN 1.0 WHEN vix / vix3m < 0.95 THEN 0.5 WHEN vix / vix3m <= 1.0 THEN 0.0 WHEN vix / vix3m <= 1.1 THEN -0.5 WHEN vix / vix3m > 1.1 THEN -1.0 END AS vix_term,
  {spread} AS spread, {then} AS spread20, CASE WHEN n >= 22 THEN {_clip(f'-(dxy / lag(dxy, 20) OVER {DAY} - 1) / 0.03')} END AS dollar,
  CASE WHEN n >= 22 THEN {relative} END AS relative, {yields} AS yields FROM counted_""",
        "scores_": f"""SELECT t, trend_spy, trend_qqq, vix_level, vix_term,
  CASE WHEN spread IS NOT NULL THEN CASE WHEN spread > 1.0 THEN 0.5 WHEN spread > 0.25 THEN 0.25 WHEN spread >= 0.0 THEN 0.0 WHEN spread > -0.5 THEN -0.25 ELSE -0.5 END - CASE WHEN spread20 < 0 AND spread - spread20 > 0.4 THEN 0.25 ELSE 0.0 END END AS yield_curve,
  dollar, CASE WHEN yields IS NULL THEN relative WHEN relative IS NULL THEN yields ELSE (yields + relative) / 2 END AS bonds FROM parts_""",
        "composed_": f"SELECT *, round(({weigh(lambda n, w: f'coalesce({n}, 0.0) * {w}')}) / nullif({total}, 0), 9) AS composite, {total} AS total, {' + '.join(f'CASE WHEN {n} IS NULL THEN 0 ELSE 1 END' for n in names)} AS parts FROM scores_",
        "regime_": f"SELECT t, {', '.join(names)}, parts, composite, least(1.0, 0.5 * least(1.0, abs(composite) / 0.6) + 0.5 * ({agree}) / total) * CASE WHEN parts < 5 THEN 0.8 ELSE 1.0 END AS confidence, CASE WHEN composite > 0.2 THEN 'RISK_ON' WHEN composite < -0.2 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM composed_ WHERE composite IS NOT NULL",
    }


def gauntlet(account: dict[str, float] | None = None) -> dict[str, str]:
    """Views up to `verdict_` (id, problem, r1 to r5, shares, verdict), from candidate_ (id, day, direction, entry, stop,
    target, catalyst, avg_dollar_volume, next_earnings, holding_days, defensive, conviction), level_ (id, level: walls of
    price; for a long resistance, for a short support), reason_ (id, category: one signal each) and regime_ (t, regime).

    r1: reward at least `reward` times the risk, also to the nearest wall on the way. r2: so many signals, of so many
    categories. r3: not against the day's regime, but for a defensive long of high conviction. r4: liquid enough, a
    position of at most `share` of the volume, a catalyst, and no earnings while it is held. r5: at least one share
    within the risk, and no leverage."""
    a = ACCOUNT | (account or {})
    long_ = "c.direction = 'long'"
    return {
        "valid_": "SELECT *, coalesce(entry > 0 AND stop > 0 AND target > 0 AND CASE WHEN direction = 'long' THEN stop < entry AND entry < target ELSE target < entry AND entry < stop END, false) AS sound, abs(entry - stop) AS risk_, abs(target - entry) AS gain_ FROM candidate_",
        "wall_": f"SELECT c.id, min(abs(w.level - c.entry)) AS near FROM valid_ c JOIN level_ w ON w.id = c.id AND CASE WHEN {long_} THEN w.level > c.entry AND w.level < c.target ELSE w.level > c.target AND w.level < c.entry END GROUP BY c.id",
        "reasons_": "SELECT id, count(*) AS signals, count(DISTINCT category) AS categories FROM reason_ GROUP BY id",
        "sized_": f"SELECT *, CASE WHEN sound THEN floor(round({a['equity']} * {a['risk']} / risk_, 9)) END AS shares FROM valid_",
        "ruled_": f"""SELECT c.id, NOT c.sound AS problem, c.shares,
  c.sound AND round(c.gain_ / nullif(c.risk_, 0), 9) >= {a['reward']} AND (w.near IS NULL OR round(w.near / nullif(c.risk_, 0), 9) >= {a['reward']}) AS r1,
  coalesce(s.signals, 0) >= {a['signals']} AND coalesce(s.categories, 0) >= {a['categories']} AS r2,
  g.regime IS NOT NULL AND NOT (({long_} AND g.regime = 'RISK_OFF' OR c.direction <> 'long' AND g.regime = 'RISK_ON') AND NOT coalesce(c.defensive AND c.conviction = 'high', false)) AS r3,
  coalesce(c.shares >= 1 AND c.shares * c.entry / {a['equity']} <= 1.0, false) AS r5,
  coalesce(c.avg_dollar_volume >= {a['volume']}, false) AND trim(coalesce(c.catalyst, '')) <> '' AND NOT coalesce(datediff(DAY, c.day, c.next_earnings) BETWEEN 0 AND coalesce(c.holding_days, {a['holding']}) + {a['buffer']}, false) AS r4_, c.avg_dollar_volume, c.entry
FROM sized_ c LEFT JOIN wall_ w ON w.id = c.id LEFT JOIN reasons_ s ON s.id = c.id LEFT JOIN regime_ g ON g.t = c.day""",
        "verdict_": f"SELECT id, problem, r1, r2, r3, r4, r5, CASE WHEN r5 THEN shares END AS shares, CASE WHEN r1 AND r2 AND r3 AND r4 AND r5 THEN 'TAKE' ELSE 'ABORT' END AS verdict FROM (SELECT *, r4_ AND NOT (r5 AND shares * entry > {a['share']} * avg_dollar_volume) AS r4 FROM ruled_)",
    }


# Eight symbols stand for the market's series, scaled to their ranges; a day without a print has the last close.
_SERIES = {"spy": ("Brand#11", 1.0), "qqq": ("Brand#12", 1.0), "vix": ("Brand#13", 70.0), "vix3m": ("Brand#14", 68.0), "us10y": ("Brand#15", 300.0), "us3m": ("Brand#16", 310.0), "dxy": ("Brand#17", 12.0), "tlt": ("Brand#18", 1.0)}
MARKET = {
    "closes_": "SELECT t, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close / {k} END) AS {n}" for n, (s, k) in _SERIES.items()) + " FROM bars_1d GROUP BY t",
    "market_": "SELECT t, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n in _SERIES) + " FROM closes_",
}
_W = "PARTITION BY symbol ORDER BY t"
CANDIDATES = {
    "setup_": f"SELECT symbol, t, close, high, low, r, volume, funding, trades, avg(close) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean, avg(volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual, avg(quote_volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS adv, max(high) OVER ({_W} ROWS BETWEEN 26 PRECEDING AND 4 PRECEDING) AS top, min(low) OVER ({_W} ROWS BETWEEN 26 PRECEDING AND 4 PRECEDING) AS bottom, avg(funding) OVER ({_W} ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING) AS paid FROM ret_1w WHERE close IS NOT NULL",
    "drawn_": "SELECT *, concat(symbol, '@', CAST(t AS VARCHAR(10))) AS id, CASE WHEN close >= mean THEN 'long' ELSE 'short' END AS direction, greatest(high - low, 0.02 * close) / 4 AS risk FROM setup_",
    "candidate_": "SELECT id, t AS day, direction, close AS entry, close - CASE WHEN direction = 'long' THEN risk ELSE -risk END AS stop, close + CASE WHEN direction = 'long' THEN risk ELSE -risk END * (2.5 + trades % 4) AS target, CASE WHEN volume > 0.8 * usual THEN 'volume' ELSE ' ' END AS catalyst, adv AS avg_dollar_volume, date_add(t, CAST(trades % 40 AS INT)) AS next_earnings, CAST(NULL AS INT) AS holding_days, trades % 3 = 0 AS defensive, CASE WHEN trades % 2 = 0 THEN 'high' ELSE 'medium' END AS conviction FROM drawn_",
    "level_": "SELECT id, top AS level FROM drawn_ WHERE top IS NOT NULL UNION ALL SELECT id, bottom FROM drawn_ WHERE bottom IS NOT NULL",
    "reason_": "SELECT id, 'technical' AS category FROM drawn_ WHERE r IS NOT NULL UNION ALL SELECT id, 'technical' FROM drawn_ WHERE close > top UNION ALL SELECT id, 'flow' FROM drawn_ WHERE volume > usual UNION ALL SELECT id, 'fundamental' FROM drawn_ WHERE funding > paid UNION ALL SELECT id, 'macro' FROM drawn_ WHERE trades % 2 = 1",
}
_SCORES = ", ".join(f"round(coalesce({n}, 9), 6) + 0.0 AS {n}" for n in WEIGHTS)  # 9: no such component
#: Limits for the scale of the test tables: weeks of a few prints
_SMALL = {"volume": 20_000.0, "share": 0.5}

GAUNTLET: dict[str, str | tuple[str, dict[str, str]]] = {
    "scr_regime_seven": (f"SELECT t, {_SCORES}, CAST(parts AS BIGINT) AS parts, {r('composite', 'composite')}, {r('confidence', 'confidence')}, regime FROM regime_", MARKET | regime()),
    "rule_five": (
        "SELECT id, problem, r1, r2, r3, r4, r5, CAST(coalesce(shares, 0) AS BIGINT) AS shares, verdict FROM verdict_",
        {k: v for k, v in (MARKET | regime()).items() if k != "regime_"} | {"regime_day_": regime()["regime_"], "regime_": "SELECT w.t, d.regime FROM (SELECT CAST(date_trunc('week', t) AS DATE) AS t, max(t) AS day FROM market_ GROUP BY CAST(date_trunc('week', t) AS DATE)) w JOIN regime_day_ d ON d.t = w.day"} | CANDIDATES | gauntlet(_SMALL),
    ),
}

#: What Spark runs instead of the statement's text: a value that equals a mean but for the rounding of sums is not above it, in whatever order they were added.
#: Margins are shares of the mean, since sums round in proportion to their size: 1e-9 for bars' sums of many prints, 1e-12 for ten closes
_TIES = (
    ("funding > paid", "funding > paid + 1e-9 * abs(paid)"), ("volume > usual", "volume > usual + 1e-9 * abs(usual)"), ("volume > 0.8 * usual", "volume > 0.8 * usual + 1e-9 * abs(usual)"),
    ("close >= mean", "close >= mean OR close >= mean - 1e-12 * abs(mean)"),
)


def settled(view: str) -> str:
    for loose, strict in _TIES:
        view = view.replace(loose, strict)
    return view


SPARK_VIEWS: dict[str, dict[str, str]] = {"rule_five": {name: settled(view) for name, view in CANDIDATES.items() if settled(view) != view}}
