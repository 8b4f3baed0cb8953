"""Market queries by name: SQL bodies over the views of `views`.

Doubles are rounded to six digits because engines add in different orders.
"""

from __future__ import annotations

TARGET_GROSS = 1.0
FEE_BPS = 12.0


def r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def book(signal: str, cost: str = f"turnover * {FEE_BPS} / 10000.0", out: str | None = None, lag: int = 1) -> tuple[str, dict[str, str]]:
    """A weight backtest. signal: all columns of ret_1w and raw. Weights are masked by price, scaled to a gross
    of 1, held `lag` bars later; turnover is against the drifted book."""
    extra = {
        "signal_": signal,
        "masked_": "SELECT symbol, t, r, close, quote_volume, CASE WHEN close IS NULL THEN 0.0 ELSE coalesce(raw, 0.0) END AS raw FROM signal_",
        "target_": "SELECT *, raw / nullif(sum(abs(raw)) OVER (PARTITION BY t), 0) AS w FROM masked_",
        "held_": f"SELECT symbol, t, close, quote_volume, coalesce(r, 0.0) AS r, CASE WHEN close IS NULL THEN 0.0 ELSE coalesce(lag(w, {lag}) OVER (PARTITION BY symbol ORDER BY t), 0.0) END AS h FROM target_",
        "port_": "SELECT *, sum(h * r) OVER (PARTITION BY t) AS pr FROM held_",
        "drift_": "SELECT *, coalesce(lag(h * (1 + r) / nullif(1 + pr, 0)) OVER (PARTITION BY symbol ORDER BY t), 0.0) AS prior FROM port_",
        "bars_": f"SELECT t, gross, turnover, {cost} AS cost, n FROM (SELECT t, sum(h * r) AS gross, sum(abs(h - prior)) AS turnover, sum(CASE WHEN h <> 0 THEN 1 ELSE 0 END) AS n FROM drift_ GROUP BY t)",
    }
    body = out or f"SELECT t, {r('gross', 'gross')}, {r('turnover', 'turnover')}, {r('cost', 'cost')}, {r('gross - cost', 'net')}, CAST(n AS BIGINT) AS positions FROM bars_"
    return body, extra


def _sr(n: str = "n", s: str = "s", ss: str = "ss") -> str:
    """Mean over deviation from a count, a sum and a sum of squares; null without deviation."""
    return f"({s} / {n}) / nullif(sqrt(greatest({ss} - {s} * {s} / {n}, 0)) / sqrt(nullif({n} - 1, 0)), 0)"


def cpcv(groups: int = 10, purge: int = 12, embargo: int = 5) -> tuple[str, dict[str, str]]:
    """Combinatorial purged cross-validation of the symbols as variants: all pairs of test groups, training rows
    purged before and purged and embargoed after each; the winner of each split's training rows gives its test rows,
    and path j joins each group's j-th occurrence. Bars are first summed into the cells that splits can tell apart
    (group, near its head, near its tail), so a split reads a few cells a variant. A group must be longer than
    purge + embargo."""
    extra = {
        "variant_": "SELECT symbol, t, coalesce(r, 0.0) AS r FROM ret_1w",
        "calendar_": f"SELECT t, g, row_number() OVER (PARTITION BY g ORDER BY t) AS head, row_number() OVER (PARTITION BY g ORDER BY t DESC) AS tail FROM (SELECT t, ntile({groups}) OVER (ORDER BY t) AS g FROM (SELECT DISTINCT t FROM variant_))",
        "cell_": f"SELECT symbol, g, h, z, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s, sum(r * r) AS ss FROM (SELECT v.symbol, v.r, c.g, c.head <= {purge + embargo} AS h, c.tail <= {purge} AS z FROM variant_ v JOIN calendar_ c ON c.t = v.t) GROUP BY symbol, g, h, z",
        "group_": "SELECT DISTINCT g FROM calendar_",
        "split_": "SELECT x.g AS a, y.g AS b FROM group_ x JOIN group_ y ON x.g < y.g",
        "train_": "SELECT a, b, symbol, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM cell_ JOIN split_ ON g <> a AND g <> b AND NOT (z AND (g + 1 = a OR g + 1 = b)) AND NOT (h AND (g - 1 = a OR g - 1 = b)) GROUP BY a, b, symbol",
        "winner_": f"SELECT a, b, symbol FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round({_sr()}, 9) DESC NULLS LAST, symbol) AS k FROM train_) WHERE k = 1",
        "placed_": "SELECT w.symbol, g.g, row_number() OVER (PARTITION BY g.g ORDER BY w.a, w.b) AS path FROM winner_ w JOIN group_ g ON g.g = w.a OR g.g = w.b",
        "path_": "SELECT p.path, count(DISTINCT p.symbol) AS winners, sum(c.n) AS n, sum(c.s) AS s, sum(c.ss) AS ss FROM placed_ p JOIN cell_ c ON c.symbol = p.symbol AND c.g = p.g GROUP BY p.path",
    }
    return f"SELECT CAST(path AS BIGINT) AS path, CAST(winners AS BIGINT) AS winners, CAST(n AS BIGINT) AS n, {r(_sr() + ' * sqrt(52)', 'sharpe')} FROM path_", extra


W = "PARTITION BY symbol ORDER BY t"


def roll(agg: str, x: str, n: int, least: int | None = None, by: str = W) -> str:
    frame = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    arg = f"{agg}({x})" if "%" not in agg else agg % x
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {arg} {frame} END"


TSMOM = "SELECT *, sign(close / nullif(lag(close, 12) OVER (PARTITION BY symbol ORDER BY t), 0) - 1) AS raw FROM ret_1w"
RANKED = "SELECT *, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY t, s IS NULL ORDER BY s DESC, symbol) END AS top, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY t, s IS NULL ORDER BY s, symbol) END AS bottom FROM ({})"
MOM = "SELECT *, lag(close, 1) OVER (PARTITION BY symbol ORDER BY t) / nullif(lag(close, 12) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS s FROM ret_1w"
REV = "SELECT *, -(close / nullif(lag(close, 2) OVER (PARTITION BY symbol ORDER BY t), 0) - 1) AS s FROM ret_1w"
STATS = f"""SELECT CAST(count(*) AS BIGINT) AS n, {r("avg(net)", "mean")}, {r("stddev_samp(net)", "sd")}, {r("avg(net) / nullif(stddev_samp(net), 0) * sqrt(52)", "sharpe")}, {r("sum(turnover)", "turnover")}, {r("max(net)", "best")}, {r("min(net)", "worst")}, {r("avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)", "hit")} FROM (SELECT *, gross - cost AS net FROM bars_)"""
EQUITY = f"""SELECT t, {r("eq", "equity")}, {r("eq / max(eq) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1", "drawdown")} FROM (SELECT t, 1 + sum(gross - cost) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM bars_)"""

ROSTER: dict[str, str | tuple[str, dict[str, str]]] = {
    # scans and panels
    "scan_symbol": f"SELECT t, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')} FROM bars_1d WHERE symbol = 'Brand#13' AND t BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
    "scan_symbols": "SELECT DISTINCT p_brand AS symbol FROM part",
    "scan_panel": f"SELECT symbol, t, {r('close', 'close')}, {r('volume', 'volume')} FROM panel_1w",
    "panel_align": "SELECT t, CAST(count(*) AS BIGINT) AS cells, CAST(count(close) AS BIGINT) AS filled FROM panel_1d GROUP BY t",
    "panel_returns": f"SELECT symbol, t, {r('r', 'r')} FROM ret_1w",
    "panel_tradable": f"SELECT symbol, t, close IS NOT NULL AND coalesce({roll('sum', 'quote_volume', 4, 1)}, 0) > 0 AND coalesce({roll('count', 'close', 12, 1)}, 0) >= 6 AS tradable FROM panel_1w",
    "panel_ppy": "SELECT CAST(count(*) AS BIGINT) AS gaps, percentile(gap, 0.5) AS median_days, round(365.25 / percentile(gap, 0.5), 6) AS ppy FROM (SELECT CAST(datediff(DAY, lag(t) OVER (ORDER BY t), t) AS DOUBLE) AS gap FROM (SELECT DISTINCT t FROM bars_1w)) WHERE gap IS NOT NULL",
    "src_dedup_keep_last": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1",
    "src_listing_window": "SELECT symbol, min(t) AS first_day, max(t) AS last_day, CAST(count(*) AS BIGINT) AS bars FROM bars_1d GROUP BY symbol",
    "src_epoch_parse": "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS micros, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000) AS BIGINT) AS millis FROM events",
    "manifest_rows": f"SELECT symbol, CAST(count(*) AS BIGINT) AS bars, min(t) AS first_ts, max(t) AS last_ts, {r('sum(close)', 'check_close')} FROM bars_1d GROUP BY symbol",
    "manifest_hash": "SELECT symbol, CAST(count(*) AS BIGINT) AS bars, sha2(array_join(array_sort(collect_list(concat(CAST(t AS VARCHAR(10)), '|', CAST(trades AS VARCHAR(20))))), ','), 256) AS content FROM bars_1d GROUP BY symbol",
    # joins
    "join_asof_backward": (
        f"SELECT f.filing, f.owner, f.symbol, p.bar_day, {r('p.close', 'close')} FROM filed_ f JOIN known_ p ON p.symbol = f.symbol AND p.day = f.published",
        {
            "filed_": "SELECT filing, owner, concat('Brand#', CAST(owner % 25 + 1 AS VARCHAR(4))) AS symbol, published FROM filings",
            "asked_": "SELECT DISTINCT symbol, published AS day FROM filed_",  # a symbol's days, however many filings
            "known_": "SELECT symbol, day, bar_day, close FROM (SELECT symbol, day, tag, max(CASE WHEN tag = 0 THEN day END) OVER w AS bar_day, last_value(close IGNORE NULLS) OVER w AS close FROM (SELECT symbol, t AS day, 0 AS tag, close FROM bars_1d UNION ALL SELECT symbol, day, 1, CAST(NULL AS DOUBLE) FROM asked_) WINDOW w AS (PARTITION BY symbol ORDER BY day, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE tag = 1 AND bar_day IS NOT NULL",
        },
    ),
    "join_asof_pit": "SELECT owner, d AS asof, filing, value FROM (SELECT f.owner, d.d, f.filing, f.value, row_number() OVER (PARTITION BY f.owner, d.d ORDER BY f.event_day DESC, f.published DESC, f.filing DESC) AS k FROM filings f JOIN (SELECT DATE '1997-06-30' AS d UNION ALL SELECT DATE '1998-06-30') d ON f.published <= d.d) WHERE k = 1",
    "join_interval_sum": f"SELECT f.filing, {r('coalesce(sum(CASE WHEN f.k > 0 THEN b.quote_volume END), 0)', 'volume')}, CAST(count(CASE WHEN f.k > 0 THEN b.t END) AS BIGINT) AS bars FROM (SELECT filing, k, date_add(event_day, CAST(k AS INT)) AS day FROM filings CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) d WHERE k <= datediff(DAY, event_day, published)) f LEFT JOIN (SELECT t, quote_volume FROM bars_1d WHERE symbol = 'Brand#21') b ON b.t = f.day GROUP BY f.filing",
    "join_next_match": "SELECT f.filing, n.next_day FROM filings f JOIN (SELECT owner, published, lead(published) OVER (PARTITION BY owner ORDER BY published) AS next_day FROM (SELECT DISTINCT owner, published FROM filings)) n ON n.owner = f.owner AND n.published = f.published",
    "join_semi_universe": f"SELECT symbol, t, {r('close', 'close')} FROM bars_1w b WHERE EXISTS (SELECT 1 FROM (SELECT symbol FROM bars_1w GROUP BY symbol HAVING sum(quote_volume) > (SELECT avg(q) FROM (SELECT sum(quote_volume) AS q FROM bars_1w GROUP BY symbol))) u WHERE u.symbol = b.symbol)",
    "join_anti_gaps": "SELECT p.symbol, p.t FROM panel_1d p WHERE NOT EXISTS (SELECT 1 FROM bars_1d b WHERE b.symbol = p.symbol AND b.t = p.t)",
    "join_full_outer_combine": f"SELECT coalesce(a.t, b.t) AS t, {r('coalesce(a.close, b.close)', 'close')}, a.t IS NULL AS second_only FROM (SELECT * FROM bars_1d WHERE symbol = 'Brand#11') a FULL OUTER JOIN (SELECT * FROM bars_1d WHERE symbol = 'Brand#12') b ON a.t = b.t",
    "join_cluster": "SELECT owner, CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n, min(event_day) AS first_day, max(event_day) AS last_day FROM (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY event_day, filing ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (SELECT *, CASE WHEN datediff(DAY, lag(event_day) OVER (PARTITION BY owner ORDER BY event_day, filing), event_day) <= 30 THEN 0 ELSE 1 END AS fresh FROM filings)) GROUP BY owner, cluster",
    # aggregations
    "agg_daily_sum": f"SELECT day, symbol, {r('sum(usd)', 'usd')}, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY day, symbol",
    "agg_last_value": "SELECT symbol, day, event_id AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1",
    "agg_bar_dense": f"SELECT symbol, t, {r('coalesce(volume, 0)', 'volume')}, CAST(coalesce(trades, 0) AS BIGINT) AS trades FROM panel_1w",
    "agg_session_bars": f"SELECT symbol, day, {r('max(CASE WHEN a = 1 THEN usd END)', 'open')}, {r('max(usd)', 'high')}, {r('min(usd)', 'low')}, {r('max(CASE WHEN z = 1 THEN usd END)', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY symbol, day ORDER BY ts DESC, event_id DESC) AS z FROM ev WHERE hour(ts) BETWEEN 9 AND 15) GROUP BY symbol, day",
    "agg_overnight_unit": f"SELECT symbol, t, {r('open / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1', 'overnight')}, {r('close / nullif(open, 0) - 1', 'intraday')} FROM bars_1d",
    "agg_carry_unit": f"SELECT s.t, {r('s.close', 'spot')}, {r('p.close', 'perp')}, {r('p.close / nullif(s.close, 0) - 1', 'basis')}, {r('p.funding', 'funding')} FROM bars_1w s JOIN bars_1w p ON p.t = s.t AND s.symbol = 'Brand#11' AND p.symbol = 'Brand#12'",
    "agg_xvenue_unit": f"SELECT a.t, {r('a.funding - b.funding', 'spread')}, {r('(a.close - b.close) / nullif((a.close + b.close) / 2, 0)', 'gap')} FROM bars_1w a JOIN bars_1w b ON a.t = b.t AND a.symbol = 'Brand#21' AND b.symbol = 'Brand#22'",
    "agg_year_table": f"SELECT symbol, CAST(extract(year FROM t) AS BIGINT) AS year, {r('sum(r)', 'total')}, {r('stddev_samp(r)', 'sd')}, CAST(count(r) AS BIGINT) AS n FROM ret_1w GROUP BY symbol, CAST(extract(year FROM t) AS BIGINT)",
    "agg_sort_table": f"SELECT CAST(bucket AS BIGINT) AS bucket, {r('avg(f)', 'forward')}, CAST(count(*) AS BIGINT) AS n FROM (SELECT ntile(5) OVER (PARTITION BY t ORDER BY r, symbol) AS bucket, f FROM (SELECT symbol, t, r, lead(r) OVER (PARTITION BY symbol ORDER BY t) AS f FROM ret_1w) WHERE r IS NOT NULL AND f IS NOT NULL) GROUP BY bucket",
    "agg_cluster_se": f"SELECT CAST(count(*) AS BIGINT) AS clusters, {r('sqrt(sum(s * s)) / sum(n) * sqrt(count(*) / greatest(count(*) - 1.0, 1.0))', 'se')} FROM (SELECT c.s - c.n * m.m AS s, c.n FROM (SELECT t, sum(r) AS s, CAST(count(*) AS DOUBLE) AS n FROM ret_1w WHERE r IS NOT NULL GROUP BY t) c CROSS JOIN (SELECT avg(r) AS m FROM ret_1w WHERE r IS NOT NULL) m)",
    "agg_fill_summary": f"SELECT l_returnflag AS side, l_linestatus AS status, CAST(count(*) AS BIGINT) AS fills, {r('sum(l_extendedprice * (1 - l_discount))', 'filled')}, {r('avg(l_tax)', 'fee')} FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_pooled_stats": f"SELECT CAST(count(*) AS BIGINT) AS n, {r('avg(f)', 'mean')}, {r('avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END)', 'win')}, {r('avg(f) / nullif(stddev_samp(f), 0) * sqrt(count(*))', 't')} FROM (SELECT r, lead(r) OVER (PARTITION BY symbol ORDER BY t) AS f FROM ret_1w) WHERE r < -0.1 AND f IS NOT NULL",
    "agg_setup_stats": f"SELECT symbol, CAST(count(*) AS BIGINT) AS n, {r('avg(f)', 'mean')}, {r('percentile(f, 0.5)', 'median')} FROM (SELECT symbol, r, lag(r) OVER (PARTITION BY symbol ORDER BY t) AS r1, lead(close, 5) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0) - 1 AS f FROM ret_1w) WHERE r < 0 AND r1 < 0 AND f IS NOT NULL GROUP BY symbol",
    "pivot_snapshots": f"SELECT day, {r("sum(CASE WHEN symbol = 'click' THEN usd END)", 'click')}, {r("sum(CASE WHEN symbol = 'view' THEN usd END)", 'view')}, {r("sum(CASE WHEN symbol = 'purchase' THEN usd END)", 'purchase')} FROM ev GROUP BY day",
    "grouping_sets_extra": f"SELECT l_returnflag, l_linestatus, {r('sum(l_extendedprice)', 'usd')}, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    # windows
    "win_sma": f"SELECT symbol, t, {r(roll('avg', 'close', 10), 'sma')} FROM panel_1w",
    "win_rvol": f"SELECT symbol, t, {r('volume / nullif(m, 0)', 'rvol')} FROM (SELECT symbol, t, volume, CASE WHEN count(volume) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS m FROM panel_1w)",
    "win_streak": "SELECT symbol, t, CAST(CASE WHEN down = 1 THEN row_number() OVER (PARTITION BY symbol, g ORDER BY t) - (CASE WHEN g = 0 THEN 0 ELSE 1 END) ELSE 0 END AS BIGINT) AS down_streak FROM (SELECT *, sum(1 - down) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT symbol, t, CASE WHEN r < 0 THEN 1 ELSE 0 END AS down FROM ret_1w))",
    "win_adv": f"SELECT symbol, t, {r(roll('avg', 'quote_volume', 20, 5), 'adv')}, {r(roll('percentile(%s, 0.5)', 'quote_volume', 20, 5), 'adv_median')} FROM panel_1w",
    "win_drawdown": f"SELECT symbol, t, {r('close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1', 'drawdown')} FROM panel_1w",
    "win_swing_levels": f"SELECT symbol, t, {r('high', 'level')} FROM (SELECT symbol, t, high, max(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m, count(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM panel_1w) WHERE high = m AND n = 7",
    "win_trend_state": f"SELECT symbol, t, CASE WHEN close > a AND a > b THEN 1 WHEN close < a AND a < b THEN -1 ELSE 0 END AS state FROM (SELECT symbol, t, close, {roll('avg', 'close', 10)} AS a, {roll('avg', 'close', 40, 20)} AS b FROM panel_1w)",
    "win_breakout_inputs": f"SELECT symbol, t, {r('h', 'channel_high')}, {r('l', 'channel_low')}, coalesce(close > h, false) AS breakout FROM (SELECT symbol, t, close, max(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h, min(low) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l FROM panel_1w)",
    "win_pct_rank": f"SELECT symbol, t, {r('(rank() OVER (PARTITION BY t ORDER BY r) + (count(*) OVER (PARTITION BY t, r) - 1) / 2.0) / count(*) OVER (PARTITION BY t)', 'pct')} FROM ret_1w WHERE r IS NOT NULL",
    "win_flow_z": f"SELECT symbol, t, {r('(usd - m) / nullif(s, 0)', 'z')} FROM (SELECT symbol, t, usd, avg(usd) OVER w AS m, CASE WHEN count(usd) OVER w >= 24 THEN stddev_samp(usd) OVER w END AS s FROM ev_1h WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))",
    "win_burst_z": f"SELECT symbol, t, {r('(n - m) / nullif(s, 0)', 'z')}, coalesce((n - m) / nullif(s, 0) > 3, false) AS burst FROM (SELECT symbol, t, n, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM ev_1h WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))",
    "win_netflow_z": f"SELECT t, {r('net', 'net')}, {r('(net - avg(net) OVER w) / nullif(stddev_samp(net) OVER w, 0)', 'z')} FROM (SELECT t, sum(CASE WHEN symbol = 'purchase' THEN usd ELSE 0 END) - sum(CASE WHEN symbol = 'click' THEN usd ELSE 0 END) AS net FROM ev_1h GROUP BY t) WINDOW w AS (ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)",
    "win_vol_target": f"SELECT symbol, t, {r('least(0.2 / nullif(s * sqrt(52), 0), 1.0)', 'scale')} FROM (SELECT symbol, t, {roll('stddev_samp', 'r', 30, 10)} AS s FROM ret_1w)",
    "win_universe_rank": f"SELECT symbol, t, CAST(k AS BIGINT) AS k, k <= 10 AS member FROM (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY v DESC, symbol) AS k FROM (SELECT symbol, t, {roll('percentile(%s, 0.5)', 'quote_volume', 30, 5)} AS v FROM panel_1w) WHERE v IS NOT NULL)",
    "win_rebalance_mask": "SELECT t, month(t) <> coalesce(month(lag(t) OVER (ORDER BY t)), 0) AS rebalance FROM (SELECT DISTINCT t FROM bars_1w)",
    "win_hold_ffill": f"SELECT symbol, t, {r('max(mark) OVER (PARTITION BY symbol, g)', 'held')} FROM (SELECT *, count(mark) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT symbol, t, CASE WHEN extract(day FROM t) <= 7 THEN close END AS mark FROM panel_1w))",
    "win_redenomination": f"SELECT symbol, t, {r('close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0)', 'jump')} FROM bars_1d WHERE volume > 0",
    "win_event_window": f"SELECT symbol, CAST(k AS BIGINT) AS k, {r('avg(x)', 'mean')}, CAST(count(x) AS BIGINT) AS n FROM (SELECT p.symbol, o.k, q.r AS x FROM (SELECT symbol, t, r, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ret_1w) p CROSS JOIN (SELECT -2 AS k UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2) o JOIN (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ret_1w) q ON q.symbol = p.symbol AND q.i = p.i + o.k WHERE p.r > 0.3) GROUP BY symbol, k",
    "win_cash_curve": f"SELECT t, {r('rate', 'rate')}, {r('sum(ln(1 + rate / 12)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'log_cash')} FROM rates",
    "win_trend_features": f"SELECT symbol, t, {r(roll('avg', 'r', 4, 2), 'm4')}, {r(roll('avg', 'r', 12, 6), 'm12')}, {r(roll('stddev_samp', 'r', 12, 6), 's12')}, {r(roll('corr(%s, r1)', 'r', 12, 12), 'ac')} FROM (SELECT symbol, t, r, lag(r) OVER (PARTITION BY symbol ORDER BY t) AS r1 FROM ret_1w)",
    # engines
    "bt_buy_hold": book("SELECT *, 1.0 AS raw FROM ret_1w"),
    "bt_tsmom": book(TSMOM),
    "bt_xsmom": book(f"SELECT *, CASE WHEN top <= 5 THEN 1.0 ELSE 0.0 END AS raw FROM ({RANKED.format(MOM)})"),
    "bt_ls_xsmom": book(f"SELECT *, CASE WHEN top <= 5 THEN 1.0 WHEN bottom <= 5 THEN -1.0 ELSE 0.0 END AS raw FROM ({RANKED.format(MOM)})"),
    "bt_reversal": book(f"SELECT *, CASE WHEN top <= 5 THEN 1.0 ELSE 0.0 END AS raw FROM ({RANKED.format(REV)})"),
    "bt_calendar": book("SELECT *, CASE WHEN extract(day FROM t) >= 25 OR extract(day FROM t) <= 3 THEN 1.0 ELSE 0.0 END AS raw FROM ret_1w"),
    "bt_funding_tilt": book("SELECT *, -round(funding - avg(funding) OVER (PARTITION BY t), 9) AS raw FROM ret_1w"),
    "bt_oi_reversal": book("SELECT *, CASE WHEN volume > 2 * avg(volume) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) THEN -sign(r) ELSE 0.0 END AS raw FROM ret_1w"),
    "bt_costs": book(TSMOM, cost="turnover * (10.0 * 0.75 + 2.0 + 1.0) / 10000.0"),
    "bt_impact": book(TSMOM, out=f"SELECT t, {r('sum(abs(h - prior) * 10000 * 0.0001 * sqrt(abs(h - prior) * 10000 / nullif(quote_volume, 0)))', 'impact')} FROM drift_ GROUP BY t"),
    "bt_whole_shares": book(TSMOM, out=f"SELECT symbol, t, {r('floor(abs(h) * 100000 / close) * close / 100000 * sign(h)', 'held')} FROM held_ WHERE close IS NOT NULL"),
    "bt_leakage": book(TSMOM, lag=2),
    "bt_stats": book(TSMOM, out=STATS),
    "bt_equity": book(TSMOM, out=EQUITY),
    "bt_held": book(TSMOM, out=f"SELECT symbol, t, {r('h', 'held')}, {r('prior', 'prior')} FROM drift_"),
    "bt_is_oos": book(TSMOM, out=f"SELECT t < DATE '1999-01-01' AS in_sample, CAST(count(*) AS BIGINT) AS n, {r('avg(gross - cost) / nullif(stddev_samp(gross - cost), 0) * sqrt(52)', 'sharpe')} FROM bars_ GROUP BY t < DATE '1999-01-01'"),
    "bt_regimes": book(TSMOM, out=f"SELECT CAST(regime AS BIGINT) AS regime, CAST(count(*) AS BIGINT) AS n, {r('avg(net)', 'mean')} FROM (SELECT net, ntile(3) OVER (ORDER BY v, t) AS regime FROM (SELECT t, gross - cost AS net, stddev_samp(gross) OVER (ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS v FROM bars_) WHERE v IS NOT NULL) GROUP BY regime"),
    "bt_best_trades": book(TSMOM, out=f"SELECT symbol, t, {r('h * r', 'pnl')} FROM held_ ORDER BY h * r DESC, symbol, t LIMIT 25"),
    "bt_capacity": book(TSMOM, out=f"SELECT {r('min(0.01 * quote_volume / nullif(abs(h), 0))', 'least')}, {r('percentile(0.01 * quote_volume / nullif(abs(h), 0), 0.5)', 'median')} FROM held_ WHERE h <> 0 AND quote_volume IS NOT NULL"),
    "bt_year_concentration": book(TSMOM, out=f"SELECT CAST(extract(year FROM t) AS BIGINT) AS year, {r('sum(gross - cost)', 'net')}, {r('sum(turnover)', 'turnover')} FROM bars_ GROUP BY CAST(extract(year FROM t) AS BIGINT)"),
    "bt_walk_forward": book(TSMOM, out=f"SELECT CAST(fold AS BIGINT) AS fold, min(t) AS first_t, max(t) AS last_t, {r('avg(gross - cost) / nullif(stddev_samp(gross - cost), 0) * sqrt(52)', 'sharpe')} FROM (SELECT *, ntile(6) OVER (ORDER BY t) AS fold FROM bars_) GROUP BY fold"),
    # statistics
    "st_moments": f"SELECT symbol, CAST(count(r) AS BIGINT) AS n, {r('avg(r)', 'mean')}, {r('stddev_samp(r)', 'sd')}, {r('avg(r) / nullif(stddev_samp(r), 0)', 'sr')}, {r('min(r)', 'lo')}, {r('max(r)', 'hi')}, {r('percentile(r, 0.05)', 'q05')} FROM ret_1w WHERE r IS NOT NULL GROUP BY symbol",
    "st_ols": f"SELECT a.symbol, {r('regr_slope(a.r, m.r)', 'beta')}, {r('regr_intercept(a.r, m.r)', 'alpha')}, {r('corr(a.r, m.r)', 'corr')} FROM ret_1w a JOIN (SELECT t, avg(r) AS r FROM ret_1w GROUP BY t) m ON a.t = m.t WHERE a.r IS NOT NULL GROUP BY a.symbol",
    "st_hac": f"SELECT CAST(count(*) AS BIGINT) AS n, {r('avg(x)', 'mean')}, {r('sqrt(greatest(sum(d * d) + 2 * sum(0.75 * d * coalesce(d1, 0) + 0.5 * d * coalesce(d2, 0) + 0.25 * d * coalesce(d3, 0)), 0)) / count(*)', 'se')} FROM (SELECT x, d, lag(d, 1) OVER (ORDER BY t) AS d1, lag(d, 2) OVER (ORDER BY t) AS d2, lag(d, 3) OVER (ORDER BY t) AS d3 FROM (SELECT t, x, x - avg(x) OVER () AS d FROM (SELECT t, avg(r) AS x FROM ret_1w WHERE r IS NOT NULL GROUP BY t)))",
    "st_cscv_blocks": f"SELECT symbol, CAST(block AS BIGINT) AS block, {r('avg(r) / nullif(stddev_samp(r), 0)', 'sr')} FROM (SELECT symbol, r, ntile(16) OVER (PARTITION BY symbol ORDER BY t) AS block FROM (SELECT symbol, t, coalesce(r, 0.0) AS r FROM ret_1w)) GROUP BY symbol, block",
    "st_cpcv": cpcv(),
    "st_adjusted_p": f"SELECT symbol, {r('t', 't_stat')}, CAST(k AS BIGINT) AS k, {r('abs(t) - sqrt(2 * ln(n / k))', 'margin')} FROM (SELECT symbol, t, row_number() OVER (ORDER BY abs(t) DESC, symbol) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT symbol, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(r)) AS t FROM ret_1w WHERE r IS NOT NULL GROUP BY symbol))",
    "st_scores": f"SELECT symbol, {r('avg(abs(r - f))', 'mae')}, {r('sqrt(avg((r - f) * (r - f)))', 'rmse')}, {r('avg(CASE WHEN sign(r) = sign(f) THEN 1.0 ELSE 0.0 END)', 'direction')} FROM (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS f FROM ret_1w) WHERE r IS NOT NULL AND f IS NOT NULL GROUP BY symbol",
    # data quality
    "qa_checks": "SELECT symbol, CAST(sum(CASE WHEN high < low THEN 1 ELSE 0 END) AS BIGINT) AS inverted, CAST(sum(CASE WHEN close <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_positive, CAST(sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_volume, CAST(sum(CASE WHEN close > high OR close < low OR open > high OR open < low THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM bars_1d GROUP BY symbol",
    "qa_gaps": "SELECT symbol, CAST(max(gap) AS BIGINT) AS longest, CAST(sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM (SELECT symbol, datediff(DAY, lag(t) OVER (PARTITION BY symbol ORDER BY t), t) AS gap FROM bars_1d) GROUP BY symbol",
    "qa_outliers": f"SELECT symbol, t, {r('r', 'r')} FROM (SELECT symbol, t, r, avg(r) OVER (PARTITION BY symbol) AS m, stddev_samp(r) OVER (PARTITION BY symbol) AS s FROM ret_1w) WHERE abs(r - m) > 4 * s",
    "qa_summary": "SELECT verdict, CAST(count(*) AS BIGINT) AS symbols FROM (SELECT CASE WHEN max(gap) > 30 THEN 'FAIL' WHEN max(gap) > 7 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT symbol, datediff(DAY, lag(t) OVER (PARTITION BY symbol ORDER BY t), t) AS gap FROM bars_1d) GROUP BY symbol) GROUP BY verdict",
    "qa_duplicates": "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    # screens, rules, books
    "scr_scan": f"SELECT symbol, t, {r('close', 'close')} FROM (SELECT symbol, t, close, r, lag(r) OVER (PARTITION BY symbol ORDER BY t) AS r1, lag(r, 2) OVER (PARTITION BY symbol ORDER BY t) AS r2, volume, avg(volume) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v FROM ret_1w) WHERE r < 0 AND r1 < 0 AND r2 < 0 AND volume > v",
    "scr_flow": f"SELECT owner, day, {r('usd', 'usd')}, {r('usd / nullif(base, 0)', 'ratio')} FROM (SELECT owner, day, usd, avg(usd) OVER (PARTITION BY owner ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS base FROM (SELECT owner, day, sum(usd) AS usd FROM ev GROUP BY owner, day)) WHERE usd > 3 * base",
    "scr_insider": "SELECT owner, published, CAST(n AS BIGINT) AS n, CAST(value AS DOUBLE) AS value FROM (SELECT owner, published, count(*) AS n, round(sum(value), 6) AS value FROM filings WHERE status = 'F' GROUP BY owner, published) WHERE n >= 2",
    "scr_regime": f"SELECT t, {r('score', 'score')}, CASE WHEN score > 0.25 THEN 'RISK_ON' WHEN score < -0.25 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM (SELECT t, avg(CASE WHEN close > s THEN 1.0 WHEN close < s THEN -1.0 END) AS score FROM (SELECT symbol, t, close, {roll('avg', 'close', 20, 10)} AS s FROM panel_1w) GROUP BY t) WHERE score IS NOT NULL",
    "rule_gauntlet": "SELECT symbol, t, rr >= 3 AS reward_risk, trades >= 3 AS signals, quote_volume > 100000 AS liquid, rr >= 3 AND trades >= 3 AND quote_volume > 100000 AS passes FROM (SELECT symbol, t, trades, quote_volume, (high - close) / nullif(close - low, 0) AS rr FROM bars_1w) WHERE rr IS NOT NULL",
    "size_1pct": f"SELECT symbol, t, CAST(floor(100.0 / (close - low)) AS BIGINT) AS shares, {r('floor(100.0 / (close - low)) * close', 'position')} FROM bars_1w WHERE close - low > 0.01",
    "journal_stats": f"SELECT o_orderpriority AS setup, CAST(count(*) AS BIGINT) AS trades, {r('avg(o_totalprice)', 'mean')}, {r("sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END)", 'closed')} FROM orders GROUP BY o_orderpriority",
    "jr_positions": f"SELECT l_suppkey AS account, l_partkey AS instrument, {r("sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)", 'quantity')} FROM lineitem GROUP BY l_suppkey, l_partkey",
    "jr_nav": f"SELECT l_suppkey AS account, day, {r('sum(flow) OVER (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'nav')} FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * (1 - l_discount) * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)) AS flow FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))",
    "jr_violations": f"SELECT account, instrument, {r('q', 'quantity')} FROM (SELECT l_suppkey AS account, l_partkey AS instrument, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE q < 0",
    "log_chain": "SELECT owner, event_id, own, lag(own) OVER (PARTITION BY owner ORDER BY event_id) AS previous FROM (SELECT owner, event_id, sha2(x, 256) AS own FROM (SELECT owner, event_id, concat(CAST(event_id AS VARCHAR(20)), '|', symbol) AS x FROM ev))",
    # streams, in their batch form
    "str_tumbling": f"SELECT symbol, date_trunc('hour', ts) AS hour, {r('sum(usd)', 'usd')}, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY symbol, date_trunc('hour', ts)",
    "str_session": f"SELECT owner, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, {r('sum(usd)', 'usd')} FROM (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (SELECT *, CASE WHEN unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY owner ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY owner, session",
    "str_sliding": f"SELECT symbol, t, {r('sum(usd) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)', 'usd_6h')} FROM ev_1h",
    "str_thin": "SELECT event_id, symbol FROM (SELECT *, lag(k) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM ev) WHERE before IS NULL OR k <> before",
}
