"""Resampling statistics as plans: bar permutation of a panel and the test built on it, block bootstrap intervals.

Draws are rows. A draw's randomness is the order (or the leading digits) of MD5 sums of
its number and the bar's, so a plan gives the same draws in any engine and on any
partitioning, and no draw is ever in one task by itself: all joins and windows are by
(draw, symbol) or by draw over one row a bar.
"""

from __future__ import annotations

from .roster import r

def uniform(h: str, at: int = 1) -> str:
    """A number in [0, 1) from 32 bits of an MD5 sum (a column of hex text), from its digit `at` on."""
    return f"(hex_long({h}, {at}, 8) / 4294967296.0)"


FIELDS = ("open", "high", "low", "quote_volume")  # travel as a ratio to their bar's close
BARS = ("volume", "trades", "funding")  # travel as they are


def permuted(draws: int, *, panel: str = "panel_1w", same: bool = True, keep_volatility: bool = False, window: int = 30) -> dict[str, str]:
    """Views up to `permuted_` (draw, symbol, j, t, close and the other fields): the panel with the order of its bars destroyed.

    Close-to-close returns are permuted and prices rebuilt from each symbol's first close; open, high, low and quote
    volume keep their ratio to their bar's close, other fields travel with their bar. One order serves all symbols
    (`same`), so symbols that trade on a bar and on its source keep their co-movement. A symbol's bar whose source it
    did not trade on takes one of the sources left over, in order of time; so each of its returns is used once.
    keep_volatility: only standardised residuals are permuted; each bar keeps its centred rolling deviation, and a
    rebuilt return is clipped to what the symbol has seen. A bar lives if it and the bar before have a positive close;
    others keep their own fields. Views: `panel` with symbol, t, close and the fields."""
    key = "concat(CAST(d.draw AS VARCHAR(20)), ':', CAST(c.j AS VARCHAR(20)))" if same else "concat(CAST(d.draw AS VARCHAR(20)), ':', c.symbol, ':', CAST(c.j AS VARCHAR(20)))"
    by = "draw" if same else "draw, symbol"
    on = "" if same else " AND {0}.symbol = {1}.symbol"
    ratios = ", ".join(f"{f} / nullif(close, 0) AS {f}" for f in FIELDS)
    half, rest = window // 2, window - window // 2 - 1
    deviation = f"CASE WHEN count(x) OVER (PARTITION BY symbol ORDER BY j ROWS BETWEEN {half} PRECEDING AND {rest} FOLLOWING) >= {max(2, window // 6)} THEN stddev_samp(x) OVER (PARTITION BY symbol ORDER BY j ROWS BETWEEN {half} PRECEDING AND {rest} FOLLOWING) END"
    views = {
        "draw_": " UNION ALL ".join(f"SELECT {k} AS draw" for k in range(draws)),
        "bar_": f"SELECT t, row_number() OVER (ORDER BY t) - 1 AS j FROM (SELECT DISTINCT t FROM {panel})",
        "shape_": f"SELECT symbol, t, j, close, {ratios}, {', '.join(BARS)}, CASE WHEN close > 0 AND before > 0 THEN close / before - 1 END AS x FROM (SELECT p.*, b.j, lag(p.close) OVER (PARTITION BY p.symbol ORDER BY b.j) AS before FROM {panel} p JOIN bar_ b ON b.t = p.t)",
        "moments_x_": "SELECT symbol, avg(x) AS mu, stddev_pop(x) AS pop, min(x) AS lo, max(x) AS hi FROM shape_ WHERE x IS NOT NULL GROUP BY symbol",
        "spread_x_": f"SELECT symbol, j, coalesce(back, first_value(back IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(back IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS sigma FROM (SELECT symbol, j, {deviation} AS back FROM shape_)",
        "live_": "SELECT s.*, m.mu, m.lo, m.hi, CASE WHEN v.sigma > 0 THEN v.sigma ELSE m.pop END AS sigma FROM shape_ s JOIN moments_x_ m ON m.symbol = s.symbol JOIN spread_x_ v ON v.symbol = s.symbol AND v.j = s.j WHERE s.x IS NOT NULL"
        if keep_volatility
        else "SELECT * FROM shape_ WHERE x IS NOT NULL",
        # place n of the sorted hashes takes the n-th bar: a permutation of the bars 1, 2, ...
        "order_": f"SELECT {by}, j AS source, row_number() OVER (PARTITION BY {by} ORDER BY h, j) AS j FROM (SELECT d.draw, {'' if same else 'c.symbol, '}c.j, md5({key}) AS h FROM {'bar_' if same else '(SELECT s.symbol, b.j FROM (SELECT DISTINCT symbol FROM shape_) s CROSS JOIN bar_ b)'} c CROSS JOIN draw_ d WHERE c.j > 0)",
        "wanted_": f"SELECT o.draw, l.symbol, l.j, o.source, s.j IS NOT NULL AS ok FROM live_ l JOIN order_ o ON o.j = l.j{on.format('o', 'l')} LEFT JOIN live_ s ON s.symbol = l.symbol AND s.j = o.source",
        "offered_": f"SELECT o.draw, l.symbol, l.j AS source, s.j IS NULL AS spare FROM live_ l JOIN order_ o ON o.source = l.j{on.format('o', 'l')} LEFT JOIN live_ s ON s.symbol = l.symbol AND s.j = o.j",
        "moved_": "SELECT draw, symbol, j, source FROM wanted_ WHERE ok UNION ALL SELECT w.draw, w.symbol, w.j, o.source FROM (SELECT *, row_number() OVER (PARTITION BY draw, symbol ORDER BY j) AS k FROM wanted_ WHERE NOT ok) w JOIN (SELECT *, row_number() OVER (PARTITION BY draw, symbol ORDER BY source) AS k FROM offered_ WHERE spare) o ON o.draw = w.draw AND o.symbol = w.symbol AND o.k = w.k",
        "carried_": "SELECT m.draw, m.symbol, m.j, "
        + ("ln(1 + greatest(least(d.mu + d.sigma * CASE WHEN s.sigma > 0 THEN (s.x - s.mu) / s.sigma ELSE 0 END, d.hi), d.lo))" if keep_volatility else "ln(1 + s.x)")
        + " AS step, "
        + ", ".join(f"s.{f}" for f in (*FIELDS, *BARS))
        + " FROM moved_ m JOIN live_ s ON s.symbol = m.symbol AND s.j = m.source"
        + (" JOIN live_ d ON d.symbol = m.symbol AND d.j = m.j" if keep_volatility else ""),
        "start_": "SELECT symbol, min_by(close, j) AS base FROM shape_ WHERE close IS NOT NULL GROUP BY symbol",
        "rebuilt_": "SELECT d.draw, p.symbol, p.j, p.t, CASE WHEN p.close IS NOT NULL THEN f.base * exp(sum(coalesce(c.step, 0)) OVER (PARTITION BY d.draw, p.symbol ORDER BY p.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS close, "
        + ", ".join(f"CASE WHEN c.draw IS NULL THEN p.{f} ELSE c.{f} END AS {f}" for f in (*FIELDS, *BARS))
        + " FROM shape_ p CROSS JOIN draw_ d JOIN start_ f ON f.symbol = p.symbol LEFT JOIN carried_ c ON c.draw = d.draw AND c.symbol = p.symbol AND c.j = p.j",
        "permuted_": f"SELECT draw, symbol, j, t, close, {', '.join(f'close * {f} AS {f}' for f in FIELDS)}, {', '.join(BARS)} FROM rebuilt_",
    }
    return views


def momentum_grid(source: str, lookbacks: tuple[int, ...] = (4, 8, 12, 26), fee: float = 12.0) -> dict[str, str]:
    """Views up to `score_` (draw, score): the best Sharpe ratio of time-series momentum over the look-backs, for every draw of `source`.

    source: draw, symbol, j, close. Signs of the look-back's return, scaled to a gross of 1, held from the next bar
    on; a change of weight costs fee basis points."""
    return {
        "grid_": " UNION ALL ".join(f"SELECT {k} AS lookback" for k in lookbacks),
        "signal_g_": f"SELECT s.draw, g.lookback, s.symbol, s.j, s.x, CASE g.lookback {' '.join(f'WHEN {k} THEN s.s{k}' for k in lookbacks)} END AS raw FROM (SELECT draw, symbol, j, close / nullif(lag(close) OVER w, 0) - 1 AS x, "
        + ", ".join(f"sign(round(close / nullif(lag(close, {k}) OVER w, 0) - 1, 12)) AS s{k}" for k in lookbacks)
        + f" FROM {source} WINDOW w AS (PARTITION BY draw, symbol ORDER BY j)) s CROSS JOIN grid_ g",
        "weight_g_": "SELECT draw, lookback, symbol, j, coalesce(x, 0.0) AS x, coalesce(raw, 0.0) / nullif(sum(abs(coalesce(raw, 0.0))) OVER (PARTITION BY draw, lookback, j), 0) AS w FROM signal_g_",
        "held_g_": "SELECT draw, lookback, symbol, j, x, coalesce(lag(w, 1) OVER v, 0.0) AS h, coalesce(lag(w, 2) OVER v, 0.0) AS prior FROM weight_g_ WINDOW v AS (PARTITION BY draw, lookback, symbol ORDER BY j)",
        "net_g_": f"SELECT draw, lookback, j, sum(h * x) - sum(abs(h - prior)) * {fee} / 10000.0 AS net FROM held_g_ GROUP BY draw, lookback, j",
        "score_": "SELECT draw, max(sharpe) AS score FROM (SELECT draw, lookback, avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe FROM net_g_ GROUP BY draw, lookback) GROUP BY draw",
    }


def bar_permutation_test(draws: int, **how: object) -> tuple[str, dict[str, str]]:
    """One row: the observed best score of the grid, its p-value among the draws' (never 0), percentile, median and 95th percentile of the null, verdict."""
    views = permuted(draws, **how) | {"both_": "SELECT draw, symbol, j, close FROM permuted_ UNION ALL SELECT -1 AS draw, symbol, j, close FROM shape_"} | momentum_grid("both_")
    views |= {
        "null_": "SELECT round(n.score, 9) AS score, round(o.score, 9) AS observed FROM (SELECT score FROM score_ WHERE draw >= 0) n CROSS JOIN (SELECT score FROM score_ WHERE draw = -1) o",
        "tested_": "SELECT max(observed) AS observed, count(*) AS n, (1.0 + sum(CASE WHEN score >= observed THEN 1 ELSE 0 END)) / (1 + count(*)) AS p, 100.0 * avg(CASE WHEN score < observed THEN 1.0 ELSE 0.0 END) AS rank_, percentile(score, 0.5) AS mid, percentile(score, 0.95) AS top FROM null_",
    }
    body = f"SELECT CAST(n AS BIGINT) AS permutations, {r('observed', 'observed')}, {r('p', 'p_value')}, {r('rank_', 'percentile')}, {r('mid', 'null_median')}, {r('top', 'null_95th')}, CASE WHEN p < 0.05 THEN 'PASS' WHEN p <= 0.1 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM tested_"
    return body, views


def panel_rows(draws: int, **how: object) -> tuple[str, dict[str, str]]:
    # a rebuilt price may be of any size: its logarithm and the other fields' ratios to it are what engines agree on
    fields = ", ".join((r("ln(close)", "log_close"), *(r(f"{f} / close", f"{f}_ratio") for f in FIELDS), r("volume", "volume"), r("funding", "funding")))
    return f"SELECT CAST(draw AS BIGINT) AS draw, symbol, t, {fields}, CAST(trades AS BIGINT) AS trades FROM permuted_ WHERE close IS NOT NULL", permuted(draws, **how)


def bootstrap_ci(draws: int, alpha: float = 0.05, per_year: int = 52, quiet: int = 5) -> tuple[str, dict[str, str]]:
    """Each symbol's annualised Sharpe ratio with the percentile interval of a stationary bootstrap.

    The mean block is Politis and White's: autocovariances up to lag ceil(sqrt(n)) + quiet; the bandwidth is twice the
    last lag before `quiet` lags in a row within 2 * sqrt(log10(n) / n); a flat-top lag window; at least 1, at most
    ceil(min(3 * sqrt(n), n / 3)). A bar starts a new block with chance 1 / block. Fewer than 20 returns, or none that
    differ, have no interval."""
    lam = "CASE WHEN 2 * k <= m THEN 1.0 ELSE 2.0 * (1.0 - k / m) END"
    views = {
        "draw_": " UNION ALL ".join(f"SELECT {k} AS draw" for k in range(draws)),
        "series_": "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, r AS x, CAST(count(*) OVER (PARTITION BY symbol) AS DOUBLE) AS n, r - avg(r) OVER (PARTITION BY symbol) AS d FROM ret_1w WHERE r IS NOT NULL",
        "step_": f"SELECT symbol, n, i AS k, ceil(sqrt(n)) + {quiet} AS top FROM series_ WHERE i <= ceil(sqrt(n)) + {quiet}",
        "covariance_": "SELECT l.symbol, l.k, l.n, l.top, sum(a.d * b.d) / l.n AS c FROM step_ l JOIN series_ a ON a.symbol = l.symbol JOIN series_ b ON b.symbol = a.symbol AND b.i = a.i - l.k GROUP BY l.symbol, l.k, l.n, l.top",
        "silent_": f"SELECT symbol, k, n, top, c, sum(CASE WHEN abs(c) < 2 * sqrt(log10(n) / n) * c0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {quiet} FOLLOWING) AS still FROM (SELECT *, max(CASE WHEN k = 0 THEN c END) OVER (PARTITION BY symbol) AS c0 FROM covariance_)",
        "width_": f"SELECT symbol, max(top) AS top, min(CASE WHEN still = {quiet} THEN k END) AS last_ FROM silent_ GROUP BY symbol",
        "window_": "SELECT s.symbol, s.n, s.k, s.c, CAST(CASE WHEN w.last_ IS NULL THEN w.top ELSE least(2 * greatest(w.last_, 1), w.top) END AS DOUBLE) AS m FROM silent_ s JOIN width_ w ON w.symbol = s.symbol",
        "long_": f"SELECT symbol, n, sum(2 * {lam} * k * c) AS g, sum(CASE WHEN k = 0 THEN c ELSE 2 * {lam} * c END) AS v FROM window_ WHERE k <= m GROUP BY symbol, n",
        "block_": "SELECT symbol, n, greatest(least(power(2 * g * g / (2 * v * v) * n, 1.0 / 3), ceil(least(3 * sqrt(n), n / 3))), 1.0) AS block FROM long_ WHERE v <> 0",
        "chance_": f"SELECT draw, i, {uniform('h')} AS u, {uniform('h', 9)} AS v FROM (SELECT d.draw, i.i, md5(concat(CAST(d.draw AS VARCHAR(20)), ':', CAST(i.i AS VARCHAR(20)))) AS h FROM draw_ d CROSS JOIN (SELECT DISTINCT i FROM series_) i)",
        "head_": "SELECT c.draw, b.symbol, b.n, c.i, CASE WHEN c.i = 0 OR c.u < 1 / b.block THEN floor(c.v * b.n) - c.i END AS shift FROM chance_ c JOIN series_ s ON s.i = c.i JOIN block_ b ON b.symbol = s.symbol",
        "drawn_": "SELECT draw, symbol, CAST((shift + i + n) % n AS BIGINT) AS i FROM (SELECT draw, symbol, n, i, last_value(shift IGNORE NULLS) OVER (PARTITION BY draw, symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shift FROM head_)",
        "sample_": f"SELECT d.draw, d.symbol, CASE WHEN stddev_samp(s.x) > 0 THEN avg(s.x) / stddev_samp(s.x) * sqrt({per_year}) ELSE 0.0 END AS sharpe FROM drawn_ d JOIN series_ s ON s.symbol = d.symbol AND s.i = d.i GROUP BY d.draw, d.symbol",
        "interval_": f"SELECT symbol, percentile(sharpe, {alpha / 2}) AS lo, percentile(sharpe, {1 - alpha / 2}) AS hi FROM sample_ GROUP BY symbol",
    }
    body = f"SELECT s.symbol, CAST(s.n AS BIGINT) AS n, {r('s.sharpe', 'sharpe')}, {r('b.block', 'block')}, {r('CASE WHEN s.n >= 20 THEN i.lo END', 'lower')}, {r('CASE WHEN s.n >= 20 THEN i.hi END', 'upper')} FROM (SELECT symbol, n, avg(x) / nullif(stddev_samp(x), 0) * sqrt({per_year}) AS sharpe FROM series_ GROUP BY symbol, n) s LEFT JOIN block_ b ON b.symbol = s.symbol LEFT JOIN interval_ i ON i.symbol = s.symbol"
    return body, views


INFERENCE: dict[str, str | tuple[str, dict[str, str]]] = {
    "st_permute_panel": panel_rows(8),
    "st_permute_panel_volatility": panel_rows(4, keep_volatility=True),
    "st_permute_each_symbol": panel_rows(2, same=False),
    "st_bar_permutation": bar_permutation_test(40),
    "st_bar_permutation_volatility": bar_permutation_test(20, keep_volatility=True),
    "st_bootstrap_ci": bootstrap_ci(200),
}
