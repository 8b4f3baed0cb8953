"""More market queries by name: alignment, joins, features, costs, sweeps, statistics, gates and journals.

Same dialect and views as `roster`. As-of joins are unions carried forward by one window per key;
no query compares rows of two tables by range alone.
"""

from __future__ import annotations

from statistics import NormalDist

from ..functions import expected_max, phi
from .roster import TSMOM, W, book, r, roll

N_VARIANTS = 25


#: Bias-corrected moments of each symbol's weekly returns
MOMENTS = {
    "sums_": "SELECT symbol, CAST(count(r) AS DOUBLE) AS n, avg(r) AS m, stddev_samp(r) AS sd, avg(r * r) AS m2, avg(r * r * r) AS m3, avg(r * r * r * r) AS m4 FROM ret_1w WHERE r IS NOT NULL GROUP BY symbol",
    "central_": "SELECT symbol, n, m, sd, (m3 - 3 * m * m2 + 2 * m * m * m) / power(m2 - m * m, 1.5) AS g1, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / power(m2 - m * m, 2) - 3 AS g2 FROM sums_ WHERE n > 3 AND m2 - m * m > 0",
    "moments_": "SELECT symbol, n, m / sd AS sr, g1 * sqrt(n * (n - 1)) / (n - 2) AS skew, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3 AS kurt FROM central_",
    "spread_": "SELECT *, sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS v FROM moments_",
}
_top = NormalDist().inv_cdf
EXPECTED_MAX = expected_max(N_VARIANTS)
DSR = MOMENTS | {
    "bar_": f"SELECT stddev_samp(sr) * {EXPECTED_MAX:.12f} AS sr0 FROM moments_",
    "dsr_": f"SELECT symbol, n, sr, {phi('((sr - sr0) * sqrt(n - 1) / v)')} AS dsr FROM spread_ CROSS JOIN bar_",
}
#: Sixteen blocks of each symbol's returns, and every way to take eight of them
CSCV = {
    "cells_": "SELECT symbol, block, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s, sum(r * r) AS ss FROM (SELECT symbol, coalesce(r, 0.0) AS r, ntile(16) OVER (PARTITION BY symbol ORDER BY t) AS block FROM ret_1w) GROUP BY symbol, block",
    "wide_": "SELECT symbol, " + ", ".join(f"max(CASE WHEN block = {b} THEN {c} END) AS {c}{b}" for b in range(1, 17) for c in ("n", "s", "ss")) + " FROM cells_ GROUP BY symbol",
    "splits_": "SELECT k AS split FROM (SELECT CAST(id AS BIGINT) AS k FROM range(65536) r(id)) WHERE bit_count(k) = 8",
    "sided_": "SELECT split, symbol, " + ", ".join(f"{' + '.join(f'{c}{b} * (split // {1 << (b - 1)} % 2)' for b in range(1, 17))} AS {c}i, {' + '.join(f'{c}{b} * (1 - split // {1 << (b - 1)} % 2)' for b in range(1, 17))} AS {c}o" for c in ("n", "s", "ss")) + " FROM splits_ CROSS JOIN wide_",
    "scored_": "SELECT split, symbol, round((si / ni) / nullif(sqrt(greatest(ssi - si * si / ni, 0) / (ni - 1)), 0), 9) AS a, round((so / no) / nullif(sqrt(greatest(sso - so * so / no, 0) / (no - 1)), 0), 9) AS b FROM sided_",
    "ranked_": "SELECT split, a, b, row_number() OVER (PARTITION BY split ORDER BY a DESC NULLS LAST, symbol) AS best, rank() OVER (PARTITION BY split ORDER BY b NULLS FIRST) + count(*) OVER (PARTITION BY split, b) - 1 AS place, count(*) OVER (PARTITION BY split) AS v FROM scored_",
    "chosen_": "SELECT split, a, b, ln((place / (v + 1.0)) / (1 - place / (v + 1.0))) AS logit FROM ranked_ WHERE best = 1",
}
PBO = "SELECT CAST(count(*) AS BIGINT) AS splits, round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS pbo, round(avg(CASE WHEN b <= 0 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS oos_loss, round(regr_slope(b, a), 4) + 0.0 AS slope FROM chosen_"
NET = {"net_": "SELECT t, gross, turnover, cost, gross - cost AS net FROM bars_"}


def engine(out: str, more: dict[str, str] | None = None, signal: str = TSMOM, **options) -> tuple[str, dict[str, str]]:
    body, extra = book(signal, out=out, **options)
    return body, extra | NET | (more or {})


SHARPE = "avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(52)"
GRID = "SELECT 4 AS look UNION ALL SELECT 8 UNION ALL SELECT 12 UNION ALL SELECT 26 UNION ALL SELECT 52"
#: A momentum sweep: one row a variant and bar, all windows by variant
SWEEP = {
    "grid_": GRID,
    "paths_": "SELECT g.look, p.symbol, p.t, p.r, p.close, CASE g.look " + " ".join(f"WHEN {k} THEN lag{k}" for k in (4, 8, 12, 26, 52)) + " END AS before FROM (SELECT *, " + ", ".join(f"lag(close, {k}) OVER ({W}) AS lag{k}" for k in (4, 8, 12, 26, 52)) + " FROM ret_1w) p CROSS JOIN grid_ g",
    "wish_": "SELECT *, CASE WHEN close IS NULL OR before IS NULL THEN 0.0 ELSE sign(round(close / before - 1, 12)) END AS raw FROM paths_",
    "lot_": "SELECT *, raw / nullif(sum(abs(raw)) OVER (PARTITION BY look, t), 0) AS w FROM wish_",
    "had_": "SELECT look, symbol, t, coalesce(r, 0.0) AS r, coalesce(lag(w) OVER (PARTITION BY look, symbol ORDER BY t), 0.0) AS h FROM lot_",
    "chg_": "SELECT *, abs(h - coalesce(lag(h * (1 + r)) OVER (PARTITION BY look, symbol ORDER BY t), 0.0)) AS d FROM had_",
    "matrix_": "SELECT look, t, sum(h * r) - sum(d) * 12.0 / 10000.0 AS net FROM chg_ GROUP BY look, t",
    "board_": f"SELECT look, count(*) AS n, {SHARPE.format('net')} AS sharpe FROM matrix_ GROUP BY look",
}
TRADES = {
    "live_": "SELECT symbol, t, h, h * r AS pnl, CASE WHEN h <> 0 AND coalesce(lag(h) OVER (PARTITION BY symbol ORDER BY t), 0.0) = 0 THEN 1 ELSE 0 END AS opens FROM held_",
    "trades_": "SELECT symbol, trade, min(t) AS opened, max(t) AS closed, count(*) AS bars, sum(pnl) AS pnl FROM (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trade FROM live_) WHERE h <> 0 GROUP BY symbol, trade",
}
#: Quotes (views) and fills (purchases) of the event stream, for as-of joins by key
BOOK = {
    "quote_": "SELECT owner, ts, event_id, usd AS px FROM ev WHERE symbol = 'view'",
    "fill_": "SELECT owner, ts, event_id, usd FROM ev WHERE symbol = 'purchase'",
    "both_": "SELECT owner, ts, 0 AS side, event_id, px, usd, 0 AS tag FROM (SELECT *, CAST(NULL AS DOUBLE) AS usd FROM quote_) UNION ALL SELECT owner, ts, 1, event_id, CAST(NULL AS DOUBLE), usd, 1 FROM fill_",
}
LAST = "last_value({} IGNORE NULLS) OVER (PARTITION BY owner ORDER BY ts, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXT = "first_value({} IGNORE NULLS) OVER (PARTITION BY owner ORDER BY ts, side, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
SECONDS = "(unix_micros(CAST({} AS TIMESTAMP)) / 1000000.0)"
CHAIN = {"chain_": "SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS day, date_add(CAST(l_shipdate AS DATE), CAST(l_orderkey % 28 AS INT)) AS expiration, l_suppkey % 10 AS strike, l_quantity * 20 AS volume, l_extendedprice / 100 AS oi FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'"}
ORDERED = {
    "intent_": "SELECT o_orderkey AS id, o_custkey AS account, o_totalprice AS notional, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders",
    "exec_": "SELECT l_orderkey AS id, l_linenumber AS seq, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS usd, l_quantity AS qty FROM lineitem",
}
FLOW = {"flow_": "SELECT symbol, t, usd, lag(usd) OVER (PARTITION BY symbol ORDER BY t) AS before FROM ev_1h"}
COSTED = f"SELECT symbol, t, abs(h - prior) AS d, h, close, quote_volume, {roll('stddev_samp', 'r', 30, 5)} AS vol, {roll('percentile(%s, 0.5)', 'quote_volume', 30, 5)} AS adv FROM drift_"
IMPACT = "greatest(coalesce(vol * sqrt(d * 100000.0 / nullif(adv, 0)), 0.0) / 0.0001 - 2.0, 0.0)"
PARTS = {
    "costed_": COSTED,
    "parts_": f"SELECT t, sum(d * 10.0) / 10000 AS commission, sum(d * 2.0) / 10000 AS spread, sum(d * {IMPACT}) / 10000 AS impact, sum(CASE WHEN h < 0 THEN -h ELSE 0.0 END) * 300.0 / 10000 / 52 AS borrow FROM costed_ GROUP BY t",
}

RESEARCH: dict[str, str | tuple[str, dict[str, str]]] = {
    # alignment
    "panel_log_returns": f"SELECT symbol, t, {r('CASE WHEN close > 0 AND p > 0 THEN ln(close) - ln(p) END', 'log_r')} FROM (SELECT symbol, t, close, lag(close) OVER ({W}) AS p FROM panel_1w)",
    "panel_price_valid": "SELECT symbol, t, coalesce(close > 0 AND (high IS NULL OR high >= greatest(open, close) * (1 - 1e-9)) AND (low IS NULL OR low <= least(open, close) * (1 + 1e-9)), false) AS valid FROM panel_1w",
    "panel_traded": "SELECT symbol, t, coalesce(close > 0, false) AND coalesce(quote_volume, 0) > 0 AND coalesce(volume, 0) >= 0 AND (coalesce(volume, 0) = 0 OR quote_volume / volume BETWEEN 0.95 * low AND 1.05 * high) AS tradable FROM panel_1w",
    "panel_nominal_ppy": "SELECT CAST(n AS BIGINT) AS bars, round(CASE WHEN n < 60 OR abs(measured - 52.0) <= 0.05 * measured THEN 52.0 ELSE measured END, 6) + 0.0 AS ppy FROM (SELECT count(*) AS n, (count(*) - 1) * 365.25 / nullif(datediff(DAY, min(t), max(t)), 0) AS measured FROM (SELECT DISTINCT t FROM bars_1w))",
    "attach_features": f"SELECT p.symbol, p.t, {r('p.close', 'close')}, {r('x.fee', 'fee')} FROM panel_1w p LEFT JOIN (SELECT symbol, t, sum(l_tax) / count(*) AS fee FROM (SELECT symbol, l_tax, CAST(date_trunc('week', day) AS DATE) AS t FROM prints WHERE l_tax > 0) GROUP BY symbol, t) x ON x.symbol = p.symbol AND x.t = p.t",
    "sandbox_split": "SELECT symbol, substr(sha2(concat('salt-1:', symbol), 256), 1, 2) < '80' AS discovery FROM (SELECT DISTINCT p_brand AS symbol FROM part)",
    "fixed_basket": "SELECT symbol, t, symbol IN ('Brand#11', 'Brand#22', 'Brand#33') AND close IS NOT NULL AS member FROM panel_1w",
    "name_exclusion": "SELECT DISTINCT p_brand AS symbol FROM part WHERE NOT (p_brand LIKE '%5' OR p_brand LIKE 'Brand#1%')",
    "excluded_bars": "SELECT symbol, CAST(count(*) AS BIGINT) AS bars, min(t) AS first_t, max(t) AS last_t FROM bars_1w WHERE NOT coalesce(close > 0 AND quote_volume / nullif(volume, 0) BETWEEN 0.95 * low AND 1.05 * high AND trades > 1, false) GROUP BY symbol",
    "interval_filter": "SELECT period, CAST(count(*) AS BIGINT) AS bars FROM (SELECT t, CAST(extract(year FROM t) * 100 + extract(month FROM t) AS BIGINT) AS period FROM bars_1d) WHERE period BETWEEN 199603 AND 199711 GROUP BY period",
    # joins
    "join_asof_tolerance": (f"SELECT event_id, CASE WHEN age <= 3600 THEN px END AS px, {r('CASE WHEN age <= 3600 THEN age END', 'age')} FROM (SELECT event_id, tag, {LAST.format('px')} AS px, {SECONDS.format('ts')} - {LAST.format(f'CASE WHEN tag = 0 THEN {SECONDS.format("ts")} END')} AS age FROM both_) WHERE tag = 1", BOOK),
    "join_asof_nearest": (f"SELECT event_id, CASE WHEN back IS NOT NULL AND (ahead IS NULL OR back <= ahead) THEN bpx ELSE apx END AS px FROM (SELECT event_id, tag, {LAST.format('px')} AS bpx, {NEXT.format('px')} AS apx, {SECONDS.format('ts')} - {LAST.format(f'CASE WHEN tag = 0 THEN {SECONDS.format("ts")} END')} AS back, {NEXT.format(f'CASE WHEN tag = 0 THEN {SECONDS.format("ts")} END')} - {SECONDS.format('ts')} AS ahead FROM both_) WHERE tag = 1 AND least(coalesce(back, 1e12), coalesce(ahead, 1e12)) <= 86400", BOOK),
    "join_asof_strict": (f"SELECT event_id, px FROM (SELECT event_id, tag, {LAST.format('px')} AS px FROM (SELECT owner, ts, 1 - side AS side, event_id, px, tag FROM both_)) WHERE tag = 1", BOOK),
    "join_asof_snapshot": "SELECT symbol, day, cut, last_event, age FROM (SELECT symbol, day, c.cut, event_id AS last_event, CAST(c.cut * 3600 - s AS BIGINT) AS age, row_number() OVER (PARTITION BY symbol, day, c.cut ORDER BY s DESC, event_id DESC) AS k FROM (SELECT symbol, day, event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM ev) e JOIN (SELECT 9 AS cut UNION ALL SELECT 12 UNION ALL SELECT 16) c ON e.s <= c.cut * 3600 + 1) WHERE k = 1",
    "join_forward_window": f"SELECT symbol, t, {r('f', 'next_funding')} FROM (SELECT symbol, t, sum(funding) OVER ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS f, count(*) OVER ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM panel_1w) WHERE n = 4",
    "join_session_calendar": "SELECT filing, session FROM (SELECT filing, day, tag, min(CASE WHEN tag = 0 THEN day END) OVER (ORDER BY day, tag DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS session FROM (SELECT 0 AS filing, day, 0 AS tag FROM (SELECT DISTINCT t AS day FROM bars_1w) UNION ALL SELECT min(filing), published, 1 FROM filings GROUP BY published)) WHERE tag = 1",
    "join_placement": "SELECT bar, CAST(max(filing) AS BIGINT) AS kept, CAST(count(*) - 1 AS BIGINT) AS collisions FROM (SELECT CAST(date_trunc('week', published) AS DATE) AS bar, filing FROM filings) GROUP BY bar",
    "join_merge_ordered": ("SELECT owner, event_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY ts, side, event_id) AS BIGINT) AS place FROM both_", BOOK),
    "join_map_full_outer": f"SELECT coalesce(a.symbol, b.symbol) AS symbol, {r('abs(coalesce(a.w, 0.0) - coalesce(b.w, 0.0))', 'error')} FROM (SELECT symbol, sum(usd) / 1000 AS w FROM prints WHERE day < DATE '1995-01-01' AND symbol < 'Brand#4' GROUP BY symbol) a FULL OUTER JOIN (SELECT symbol, sum(usd) / 1000 AS w FROM prints WHERE day >= DATE '1995-01-01' AND symbol > 'Brand#2' GROUP BY symbol) b ON a.symbol = b.symbol",
    "join_self_lag_period": f"SELECT owner, period, {r('value', 'value')}, {r('CASE WHEN p = period - 1 THEN v ELSE 0.0 END', 'previous')} FROM (SELECT owner, period, value, lag(period) OVER (PARTITION BY owner ORDER BY period) AS p, lag(value) OVER (PARTITION BY owner ORDER BY period) AS v FROM (SELECT owner, CAST(extract(year FROM published) * 12 + extract(month FROM published) AS BIGINT) AS period, sum(value) AS value FROM filings GROUP BY 1, 2))",
    # aggregations
    "agg_realised_var": f"SELECT symbol, day, {r('sum(x * x)', 'rv')}, CAST(count(x) AS BIGINT) AS n FROM (SELECT symbol, CAST(t AS DATE) AS day, ln(usd / before) AS x FROM flow_ WHERE usd > 0 AND before > 0) GROUP BY symbol, day",
    "agg_flow_diff": f"SELECT symbol, t, {r('(usd - before) * peak', 'flow')} FROM (SELECT symbol, t, usd, peak, lag(usd) OVER (PARTITION BY symbol ORDER BY t) AS before FROM ev_1h)",
    "agg_calls_by_strike": (f"SELECT ticker, expiration, strike, {r('volume', 'volume')}, {r('oi', 'oi')}, {r('volume / sum(volume) OVER (PARTITION BY ticker)', 'share')} FROM (SELECT ticker, expiration, strike, sum(volume) AS volume, sum(oi) AS oi FROM chain_ GROUP BY ticker, expiration, strike)", CHAIN),
    "agg_option_baseline": (f"SELECT ticker, day, {r('avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)', 'baseline')} FROM (SELECT ticker, day, sum(volume) AS volume FROM chain_ GROUP BY ticker, day)", CHAIN),
    "agg_gross_open": (f"SELECT account, {r("sum(CASE WHEN status = 'O' THEN notional ELSE 0 END)", 'reserved')}, {r("sum(CASE WHEN status <> 'O' THEN abs(notional) ELSE 0 END)", 'open_usd')} FROM intent_ GROUP BY account", ORDERED),
    "agg_per_trade": engine(f"SELECT t, {r('x', 'net_4')} FROM (SELECT t, sum(net) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS x, count(*) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS n FROM net_) WHERE n = 4"),
    "agg_forward_summary": engine(f"SELECT CAST(count(*) AS BIGINT) AS n, {r(SHARPE.format('net'), 'sharpe')}, {r('exp(sum(ln(greatest(1 + net, 1e-9)))) - 1', 'total')}, {r('sum(cost) / nullif(sum(turnover) * 0.0012, 0)', 'cost_ratio')} FROM net_ WHERE t >= DATE '1997-01-01'"),
    "topk_largest_bars": engine(f"SELECT {r('sum(net)', 'net')}, {r('sum(CASE WHEN k > 5 THEN net ELSE 0.0 END)', 'without_best')} FROM (SELECT net, row_number() OVER (ORDER BY net DESC, t) AS k FROM net_)"),
    "topk_group_best": "SELECT owner, month, filing FROM (SELECT owner, filing, CAST(date_trunc('month', event_day) AS DATE) AS month, row_number() OVER (PARTITION BY owner, date_trunc('month', event_day) ORDER BY value DESC, filing) AS k FROM filings) WHERE k = 1",
    "distinct_owner_count": "SELECT published, CAST(count(DISTINCT owner) AS BIGINT) AS owners FROM filings GROUP BY published",
    # windows
    "win_every_n": "SELECT t, (row_number() OVER (ORDER BY t) - 1) % 4 = 0 AS mark FROM (SELECT DISTINCT t FROM bars_1w)",
    "win_round_trips": engine("SELECT symbol, CAST(sum(opens) AS BIGINT) AS round_trips FROM live_ GROUP BY symbol", TRADES),
    "win_pct_rank_trailing": f"SELECT symbol, t, {r('100.0 * count_le(closes, close) / 26', 'pct')} FROM (SELECT symbol, t, close, collect_list(close) OVER ({W} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS closes, count(close) OVER ({W} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS n FROM bars_1w) WHERE n = 26",
    "win_returns_multi": "SELECT symbol, t, " + ", ".join(r(f"CASE WHEN count(x) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} THEN sum(x) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END", f"log_{k}") for k in (1, 2, 4, 12)) + f", {r(roll('stddev_samp', 'x', 12, 6), 'vol_12')} FROM (SELECT symbol, t, CASE WHEN r > -1 THEN ln(1 + r) END AS x FROM ret_1w)",
    "win_as_feature": f"SELECT symbol, t, {r('lag(v, 1) OVER (PARTITION BY symbol ORDER BY t)', 'feature')} FROM (SELECT symbol, t, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM panel_1w)",
    "win_drawdown_product": engine(f"SELECT t, {r('q', 'equity')}, {r('q / max(q) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1', 'drawdown')} FROM (SELECT t, exp(sum(ln(greatest(1 + net, 1e-9))) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM net_)"),
    "win_redenomination_bars": f"SELECT symbol, t FROM (SELECT symbol, t, j, {', '.join(f'lead(j, {k}) OVER ({W}) AS j{k}' for k in range(1, 6))} FROM (SELECT symbol, t, close / nullif(lag(close) OVER ({W}), 0) AS j FROM bars_1d)) WHERE abs(j - 1) > 0.5 AND (" + " OR ".join(f"abs({' * '.join(['j', *(f'j{i}' for i in range(1, k + 1))])} - 1) <= 0.05" for k in range(1, 6)) + ")",
    "win_unlock_cross": f"SELECT symbol, t, max(CASE WHEN z AND NOT coalesce(y, false) THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS hold FROM (SELECT symbol, t, z, lag(z) OVER ({W}) AS y FROM (SELECT symbol, t, coalesce(volume > 200, false) AS z FROM panel_1w))",
    "win_vol_snapshot": f"SELECT symbol, {r('stddev_samp(r) * sqrt(52)', 'vol')}, {r('corr(r, m)', 'corr')} FROM (SELECT symbol, r, avg(r) OVER (PARTITION BY t) AS m FROM ret_1w WHERE r IS NOT NULL) GROUP BY symbol",
    # order and sets
    "sort_stable_by_time": "SELECT event_id, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS BIGINT) AS place FROM ev",
    "limit_tail": f"SELECT symbol, t, {r('close', 'close')} FROM (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM bars_1w) WHERE k <= 10",
    "median_variant": ("SELECT look FROM (SELECT look, row_number() OVER (ORDER BY round(sharpe, 9), look) AS k, count(*) OVER () AS n FROM board_) WHERE k = ceil(n / 2.0)", SWEEP),
    "set_intersect": "SELECT t FROM bars_1d WHERE symbol = 'Brand#11' INTERSECT SELECT t FROM bars_1d WHERE symbol = 'Brand#12'",
    # engines and costs
    "bt_funding_pnl": engine(f"SELECT h.t, {r('-sum(h.h * coalesce(p.funding, 0.0))', 'funding')} FROM held_ h JOIN panel_1w p ON p.symbol = h.symbol AND p.t = h.t GROUP BY h.t"),
    "bt_fill_haircut": engine(f"SELECT t, {r('sum(h * r * CASE WHEN extract(day FROM t) <= 7 THEN 0.8 ELSE 0.9 END)', 'gross')} FROM held_ GROUP BY t"),
    "bt_leakage_table": engine(f"SELECT {r(SHARPE.format('a'), 'lag_0')}, {r(SHARPE.format('b'), 'lag_1')}, {r(SHARPE.format('c'), 'lag_2')}, {r(f"({SHARPE.format('b')} - greatest({SHARPE.format('a')}, {SHARPE.format('c')})) / sqrt(52.0 / count(*))", 'spike_z')} FROM probe_", {"lagged_": f"SELECT t, coalesce(r, 0.0) AS r, close, w AS w0, lag(w) OVER ({W}) AS w1, lag(w, 2) OVER ({W}) AS w2 FROM target_", "probe_": "SELECT t, sum(coalesce(w0, 0.0) * r) AS a, sum(coalesce(w1, 0.0) * r) AS b, sum(coalesce(w2, 0.0) * r) AS c FROM lagged_ WHERE close IS NOT NULL GROUP BY t"}),
    "bt_net_over_gross": engine(f"SELECT {r(f"CASE WHEN {SHARPE.format('gross')} >= sqrt(52.0 / count(*)) THEN sum(net) / nullif(sum(gross), 0) END", 'ratio')} FROM net_"),
    "bt_legs": engine(f"SELECT symbol, t, leg, {r('w', 'weight')} FROM (SELECT symbol, t, 'long' AS leg, greatest(h, 0.0) AS w FROM held_ UNION ALL SELECT symbol, t, 'short', greatest(-h, 0.0) FROM held_) WHERE w > 0"),
    "bt_trades": engine(f"SELECT symbol, opened, closed, CAST(bars AS BIGINT) AS bars, {r('pnl', 'pnl')} FROM trades_", TRADES),
    "bt_drop_best_trades": engine(f"SELECT {r('a.pnl', 'pnl')}, {r('a.pnl - b.best', 'without_best')} FROM (SELECT sum(pnl) AS pnl FROM trades_) a CROSS JOIN (SELECT sum(pnl) AS best FROM (SELECT pnl FROM trades_ ORDER BY round(pnl, 9) DESC, symbol, opened LIMIT 5)) b", TRADES),
    "cost_commission": engine(f"SELECT t, {r('sum(CASE WHEN s > 0 THEN least(greatest(0.0035 * s, 0.35), 0.01 * s * close) ELSE 0.0 END) / 10', 'commission_bps')} FROM (SELECT t, close, floor(round(abs(h - prior) * 100000 / close, 6)) AS s FROM drift_ WHERE close > 0) GROUP BY t"),
    "cost_components": engine(f"SELECT t, {r('commission', 'commission')}, {r('spread', 'spread')}, {r('impact', 'impact')}, {r('borrow', 'borrow')}, {r('commission + spread + impact + borrow', 'total')}, {r('2 * (commission + spread + impact + borrow)', 'stressed')} FROM parts_", PARTS),
    "sweep_run": (f"SELECT look, CAST(n AS BIGINT) AS n, {r('sharpe', 'sharpe')} FROM board_", SWEEP),
    "sweep_best": (f"SELECT b.look, {r('b.sharpe', 'sharpe')}, {r('sum(CASE WHEN o.sharpe >= 0.5 * b.sharpe THEN 1.0 ELSE 0.0 END) / count(*)', 'retention')} FROM (SELECT look, sharpe FROM (SELECT *, row_number() OVER (ORDER BY round(sharpe, 9) DESC, look) AS k FROM board_) WHERE k = 1) b CROSS JOIN board_ o GROUP BY b.look, b.sharpe", SWEEP),
    "size_sweep": engine(f"SELECT equity, {r('sum(d * greatest(coalesce(vol * sqrt(d * equity / nullif(adv, 0)), 0.0) / 0.0001 - 2.0, 0.0)) / 10000', 'impact')} FROM costed_ CROSS JOIN (SELECT 1000.0 AS equity UNION ALL SELECT 100000.0 UNION ALL SELECT 10000000.0) GROUP BY equity", PARTS),
    "kill_test": engine(f"SELECT {r('avg(gross) / nullif(avg(cost), 0)', 'edge_over_cost')}, {r('avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(count(*))', 't')}, CASE WHEN avg(gross) <= 0 THEN 'no edge' WHEN avg(gross) < 2 * avg(cost) THEN 'below cost' ELSE 'alive' END AS verdict FROM net_"),
    # statistics
    "st_shape": (f"SELECT symbol, CAST(n AS BIGINT) AS n, {r('sr', 'sr')}, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt FROM moments_", MOMENTS),
    "st_psr": (f"SELECT symbol, round({phi('(sr * sqrt(n - 1) / v)')}, 5) + 0.0 AS psr FROM spread_", MOMENTS),
    "st_mintrl": (f"SELECT symbol, round(CASE WHEN sr > 0.001 THEN 1 + v * v * power({_top(0.95):.12f} / sr, 2) END, 2) + 0.0 AS bars FROM spread_", MOMENTS),
    "st_dsr": ("SELECT symbol, round(dsr, 5) + 0.0 AS dsr FROM dsr_", DSR),
    "st_sharpe_se": (f"SELECT symbol, {r('sqrt(52.0 / n)', 'se')}, {r(f'CASE WHEN abs(sr) > 0.001 THEN 2 * ln({N_VARIANTS}.0) / (sr * sr * 52) END', 'min_years')} FROM moments_", MOMENTS),
    "st_multiple_p": (f"SELECT symbol, round(p, 5) + 0.0 AS p, round(least(p * n, 1.0), 5) + 0.0 AS bonferroni, round(max(least(p * (n - k + 1), 1.0)) OVER (ORDER BY p, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) + 0.0 AS holm, round(min(least(p * n / k, 1.0)) OVER (ORDER BY p, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) + 0.0 AS bh FROM (SELECT symbol, p, row_number() OVER (ORDER BY p, symbol) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT symbol, round(2 * (1 - {phi('abs(sr * sqrt(n))')}), 9) AS p FROM moments_))", MOMENTS),
    "st_cscv_pbo": (PBO, CSCV),
    "st_compare": (f"SELECT {r('avg(d)', 'mean')}, {r('avg(d) / nullif(stddev_samp(d), 0) * sqrt(count(*))', 't')}, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.net - b.net AS d FROM matrix_ a JOIN matrix_ b ON a.t = b.t AND a.look = 12 AND b.look = 52)", SWEEP),
    "st_sizing": engine(f"SELECT {r('least(0.5 * sr / sd, 2.0 * sr / (sd * (ln(0.1) / ln(0.75) + 1)), 0.15 / sd)', 'leverage')} FROM (SELECT {SHARPE.format('net')} AS sr, stddev_samp(net) * sqrt(52) AS sd FROM net_)"),
    "st_shuffles": "SELECT symbol, t, CAST(row_number() OVER (PARTITION BY symbol, date_trunc('month', t) ORDER BY sha2(concat('7:', symbol, ':', CAST(t AS VARCHAR(20))), 256)) AS BIGINT) AS place FROM bars_1w",
    "st_touch_prob": f"SELECT symbol, t, round({phi('z')}, 5) + 0.0 AS terminal, round(least(2 * {phi('z')}, 1.0), 5) + 0.0 AS touch FROM (SELECT symbol, t, -abs(ln(close / (close * 1.1))) / nullif(s * 2.0, 0) AS z FROM (SELECT symbol, t, close, {roll('stddev_samp', 'r', 30, 10)} AS s FROM ret_1w)) WHERE z IS NOT NULL",
    # signals
    "sig_random_entry": "SELECT symbol, t FROM (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY sha2(concat('7:', CAST(block AS VARCHAR(20)), ':', symbol), 256)) AS k FROM (SELECT p.symbol, p.t, b.block FROM panel_1w p JOIN (SELECT t, CAST((row_number() OVER (ORDER BY t) - 1) // 8 AS BIGINT) AS block FROM (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS t FROM prints)) b ON b.t = p.t)) WHERE k <= 5",
    "sig_etf_flow": (f"SELECT symbol, t, least(greatest(sum(CASE WHEN abs(z) >= 1.5 THEN sign(z) ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), -1.0), 1.0) + 0.0 AS w FROM (SELECT symbol, t, usd / nullif(avg(abs(usd)) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0) AS z FROM ev_1h)"),
    "sig_auction_fade": "SELECT symbol, t FROM (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY gap, symbol) AS k FROM (SELECT symbol, t, round(close / nullif(open, 0) - 1, 9) AS gap, quote_volume FROM bars_1w) WHERE gap <= -0.05 AND quote_volume >= 100000) WHERE k <= 5",
    "sig_late_day": "SELECT symbol, t, CASE WHEN close / nullif(open, 0) - 1 >= 0.05 THEN 1 ELSE 0 END AS w FROM bars_1w",
    "sig_unlock_fade": "SELECT symbol, t FROM (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY v DESC, symbol) AS k FROM (SELECT symbol, t, round(lead(volume) OVER (PARTITION BY symbol ORDER BY t) / nullif(volume, 0), 9) AS v FROM bars_1w) WHERE v >= 2) WHERE k <= 5",
    # journals, logs, rules
    "jr_stage": ("SELECT account, CAST(count(*) AS BIGINT) AS intents, CAST(count(DISTINCT digest) AS BIGINT) AS digests FROM (SELECT account, sha2(concat(CAST(account AS VARCHAR(20)), ':', status), 256) AS digest FROM intent_) GROUP BY account HAVING count(DISTINCT digest) > 1", ORDERED),
    "jr_transition": ("SELECT account, id, before, status FROM (SELECT account, id, status, lag(status) OVER (PARTITION BY account ORDER BY day, id) AS before FROM intent_) WHERE before IS NOT NULL AND NOT (before = 'O' OR before = status)", ORDERED),
    "jr_execution": (f"SELECT id, seq, {r('done', 'done')}, done > notional AS overfill FROM (SELECT e.id, e.seq, i.notional, sum(e.usd) OVER (PARTITION BY e.id ORDER BY e.seq, e.usd, e.qty, e.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM exec_ e JOIN intent_ i ON i.id = e.id)", ORDERED),
    "jr_cash_event": "SELECT owner, day, min(event_id) AS posted, CAST(count(*) AS BIGINT) AS seen FROM ev GROUP BY owner, day",
    "lim_check_entry": ("SELECT id, concat_ws('; ', CASE WHEN notional > 300000 THEN 'too large' END, CASE WHEN status <> 'O' THEN 'not open' END, CASE WHEN total > 1500000 THEN 'account limit' END) AS reasons FROM (SELECT id, notional, status, sum(notional) OVER (PARTITION BY account) AS total FROM intent_)", ORDERED),
    "log_hash_chain": ("SELECT owner, event_id, h AS own, coalesce(lag(h) OVER (PARTITION BY owner ORDER BY ts, event_id), 'genesis') AS previous, sha2(concat(coalesce(lag(h) OVER (PARTITION BY owner ORDER BY ts, event_id), 'genesis'), h), 256) AS link FROM (SELECT owner, event_id, ts, sha2(concat(CAST(event_id AS VARCHAR(20)), '|', symbol), 256) AS h FROM ev)"),
    "log_trial_count": ("SELECT account, CAST(sum(CASE WHEN status = 'P' THEN 0 ELSE 1 END) AS BIGINT) AS trials FROM intent_ GROUP BY account", ORDERED),
    "log_forward": "SELECT owner, day, event_id FROM (SELECT owner, day, event_id, row_number() OVER (PARTITION BY owner, day ORDER BY ts, event_id) AS k FROM ev) WHERE k = 1",
    "scr_unusual_calls": (f"SELECT ticker, day, expiration, strike, {r('volume / base', 'ratio')}, concat_ws('; ', CASE WHEN volume > oi THEN 'volume above open interest' END, CASE WHEN n < 20 THEN 'short baseline' END) AS notes FROM (SELECT *, avg(volume) OVER (PARTITION BY ticker ORDER BY day, expiration, strike, oi ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS base, count(volume) OVER (PARTITION BY ticker ORDER BY day, expiration, strike, oi ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT ticker, day, expiration, strike, sum(volume) AS volume, round(sum(oi), 2) AS oi FROM chain_ GROUP BY ticker, day, expiration, strike)) WHERE datediff(DAY, day, expiration) BETWEEN 0 AND 14 AND volume >= 500 AND volume / base >= 1.5", CHAIN),
    "scr_cross_reference": "SELECT owner, CASE WHEN up > down AND f > o THEN 'agree up' WHEN up < down AND f < o THEN 'agree down' WHEN up = down OR f = o THEN 'neutral' ELSE 'conflict' END AS verdict FROM (SELECT owner, sum(CASE WHEN value > 150000 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN value <= 150000 THEN 1 ELSE 0 END) AS down, sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) AS o FROM filings GROUP BY owner)",
    "cand_validate": "SELECT symbol, t, close > close - 1.5 * (high - low) AND high > low AS geometry, round(close - 1.5 * (high - low), 6) + 0.0 AS stop, round(close + 4.5 * (high - low), 6) + 0.0 AS target FROM bars_1w WHERE high IS NOT NULL",
    # data quality
    "qa_taker_within_volume": "SELECT symbol, CAST(sum(CASE WHEN taker > volume + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS offenders FROM (SELECT symbol, day, sum(qty) AS volume, sum(CASE WHEN l_tax > 0.04 THEN qty ELSE 0 END) AS taker FROM prints GROUP BY symbol, day) GROUP BY symbol",
    "qa_quote_volume": "SELECT symbol, CAST(sum(CASE WHEN volume > 0 AND NOT quote_volume / volume BETWEEN 0.95 * low AND 1.05 * high THEN 1 ELSE 0 END) AS BIGINT) AS offenders FROM bars_1d GROUP BY symbol",
    "qa_frozen_price": f"SELECT symbol, CAST(sum(CASE WHEN z >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS frozen FROM (SELECT symbol, sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS z FROM ret_1w) GROUP BY symbol",
    "qa_extreme_returns": f"SELECT symbol, t, {r('r', 'r')} FROM ret_1d WHERE abs(r) > 0.8",
    "qa_non_empty": "SELECT s.symbol, CAST(count(b.t) AS BIGINT) AS bars, count(b.t) > 0 AS passes FROM (SELECT DISTINCT p_brand AS symbol FROM part) s LEFT JOIN bars_1d b ON b.symbol = s.symbol GROUP BY s.symbol",
    # gates over one momentum book and over the symbols as variants
    "gate_2_costs": engine(f"SELECT {r('sum(net) / nullif(sum(gross), 0)', 'ratio')}, {r(SHARPE.format('(gross - 2 * cost)'), 'stressed')}, CASE WHEN NOT coalesce(sum(net) / nullif(sum(gross), 0) >= 0.5, false) OR NOT coalesce({SHARPE.format('(gross - 2 * cost)')} > 0, false) THEN 'FAIL' WHEN sum(net) / sum(gross) < 0.6 THEN 'WARN' ELSE 'PASS' END AS verdict FROM net_"),
    "gate_3_significance": (f"SELECT symbol, round(sr * sqrt(n), 5) + 0.0 AS t, round(psr, 5) + 0.0 AS psr, CASE WHEN sr * sqrt(n) < 2.5 THEN 'FAIL' WHEN sr * sqrt(n) < 3 OR psr < 0.95 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT symbol, n, sr, {phi('(sr * sqrt(n - 1) / v)')} AS psr FROM spread_)", MOMENTS),
    "gate_4_deflation": (f"SELECT symbol, round(dsr, 5) + 0.0 AS dsr, CASE WHEN dsr < 0.9 THEN 'FAIL' WHEN dsr < 0.95 OR 2 * ln({N_VARIANTS}.0) / nullif(sr * sr * 52, 0) > n / 52 THEN 'WARN' ELSE 'PASS' END AS verdict FROM dsr_", DSR),
    "gate_5_selection": (f"SELECT pbo, oos_loss, CASE WHEN pbo < 0.1 THEN 'PASS' WHEN pbo <= 0.2 OR oos_loss <= 0.1 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM ({PBO})", CSCV),
    "gate_8_robustness": engine("SELECT CAST(years AS BIGINT) AS years, CAST(good AS BIGINT) AS good, CAST(trips AS BIGINT) AS trips, CASE WHEN trips < 50 OR good * 3 < years * 2 OR total - best <= 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT count(*) AS years, sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS good, sum(net) AS total, max(net) AS best FROM (SELECT extract(year FROM t) AS y, sum(net) AS net FROM net_ GROUP BY extract(year FROM t))) CROSS JOIN (SELECT sum(opens) AS trips FROM live_)", TRADES),
    # streams, in their batch form
    "str_merge_order": ("SELECT owner, event_id, tag, CAST(row_number() OVER (PARTITION BY owner ORDER BY ts, tag, event_id) AS BIGINT) AS seq FROM both_", BOOK),
    "str_dedup": "SELECT owner, symbol, day, min(event_id) AS kept, CAST(count(*) AS BIGINT) AS copies, count(DISTINCT usd) > 1 AS conflict FROM ev GROUP BY owner, symbol, day",
    "str_staleness": f"SELECT event_id, {r(f"{SECONDS.format('ts')} - lag({SECONDS.format('ts')}) OVER (PARTITION BY symbol ORDER BY ts, event_id)", 'age')} FROM ev",
    "str_heartbeat": f"SELECT symbol, max(ts) AS last_seen, {r(f"max(max({SECONDS.format('ts')})) OVER () - max({SECONDS.format('ts')})", 'age')} FROM ev GROUP BY symbol",
}
RESEARCH["agg_realised_var"] = (RESEARCH["agg_realised_var"], FLOW)

#: What Spark runs instead. Executions are summed before the join, whose order the window's is, so a task sorts them once.
#: Where an order's id has m rows, the j-th stands for the j-th copy of each execution in the order that the join would make.
SPARK_VIEWS: dict[str, dict[str, str]] = {
    "jr_execution": {
        "body": f"SELECT id, seq, {r('done', 'done')}, done > notional AS overfill FROM (SELECT e.id, e.seq, i.notional, CASE WHEN i.m = 1 THEN e.done ELSE i.m * (e.done - e.usd) + i.j * e.usd END AS done FROM filled_ e JOIN numbered_ i ON i.id = e.id)",
        "filled_": "SELECT id, seq, usd, sum(usd) OVER (PARTITION BY id ORDER BY seq, usd, qty, day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM exec_",
        "numbered_": "SELECT id, notional, count(*) OVER (PARTITION BY id ORDER BY notional ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m, row_number() OVER (PARTITION BY id ORDER BY notional) AS j FROM intent_",
    }
}
