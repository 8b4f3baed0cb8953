"""Sessions cut at a decision time, and rolling ranks of decisions."""

from __future__ import annotations

from .roster import r

OPEN, CLOSE, LATE = 9 * 60 + 30, 16 * 60, 15 * 60 + 45


def session_split(decision: int = 15 * 60 + 30) -> dict[str, str]:
    """Views up to `split_`: two bars for each symbol and session of minutes_ (symbol, ts: local time at which a minute
    starts, open, close, volume): from the open to the decision (minutes after midnight), and from it to the close.

    A minute that starts at the decision is not known by then. Sessions without minutes on both sides, or that end
    before 15:45, are left out. The closing price is the first print of the minute at 16:00 where there is one, else
    the last close. Prices are continuous: a bar's return is its part's own, the gap overnight is dropped."""
    return {
        "regular_": f"SELECT *, CAST(ts AS DATE) AS day FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM minutes_) WHERE m BETWEEN {OPEN} AND {CLOSE}",
        "early_": f"SELECT symbol, day, min_by(open, m) AS first_, max_by(close, m) AS price, sum(volume) AS volume FROM regular_ WHERE m < {decision} GROUP BY symbol, day",
        "after_": f"SELECT symbol, day, max_by(CASE WHEN m = {CLOSE} THEN open ELSE close END, m) AS price, sum(volume) AS volume, max(m) AS last_ FROM regular_ WHERE m >= {decision} GROUP BY symbol, day",
        "whole_": f"SELECT e.symbol, e.day, e.first_, e.price AS decided, a.price AS closed, e.volume AS early, a.volume AS late FROM early_ e JOIN after_ a ON a.symbol = e.symbol AND a.day = e.day WHERE a.last_ >= {LATE}",
        "part_": "SELECT symbol, day, 0 AS is_late, first_ AS a, decided AS z, early AS volume, decided / first_ - 1 AS ret_to_decision, first_ AS session_open FROM whole_ UNION ALL SELECT symbol, day, 1, decided, closed, late, NULL, NULL FROM whole_",
        "priced_": "SELECT *, first_value(a) OVER (PARTITION BY symbol ORDER BY day, is_late ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * exp(sum(ln(z / a)) OVER (PARTITION BY symbol ORDER BY day, is_late ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS price FROM part_",
        "split_": "SELECT symbol, day, is_late, price * a / z AS open, greatest(price, price * a / z) AS high, least(price, price * a / z) AS low, price AS close, volume * z AS quote_volume, volume * z / price AS volume, session_open, ret_to_decision FROM priced_",
    }


def rolling_rank(window: int = 24, least: int = 6, ceiling: float = 0.9, mean: int = 4) -> dict[str, str]:
    """Views up to `ranked_` (symbol, t, score, pct, hot): the trailing mean of funding, its rank (in (0, 1], ties share
    their mean rank) among the last `window` decisions with a score, and whether that is above `ceiling`.

    Decisions are the first bars of months; between them the last rank holds. Fewer than `least` scores give no rank."""
    by, frame = "PARTITION BY symbol ORDER BY t", f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    return {
        "marked_": f"SELECT symbol, t, CASE WHEN count(funding) OVER ({by} ROWS BETWEEN {mean - 1} PRECEDING AND CURRENT ROW) = {mean} THEN round(avg(funding) OVER ({by} ROWS BETWEEN {mean - 1} PRECEDING AND CURRENT ROW), 12) END AS score, month(t) <> coalesce(month(lag(t) OVER ({by})), 0) AS mark FROM panel_1w",
        "held_r_": f"SELECT symbol, t, score, collect_list(score) OVER ({by} {frame}) AS scores, count(score) OVER ({by} {frame}) AS n FROM marked_ WHERE mark",
        "pct_": f"SELECT symbol, t, CASE WHEN n >= {least} AND score IS NOT NULL THEN (count_le(scores, score) + count_lt(scores, score) + 1) / 2.0 / n END AS pct FROM held_r_",
        "ranked_": f"SELECT symbol, t, score, pct, coalesce(pct > {ceiling}, false) AS hot FROM (SELECT m.symbol, m.t, m.score, last_value(p.pct IGNORE NULLS) OVER (PARTITION BY m.symbol ORDER BY m.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pct FROM marked_ m LEFT JOIN pct_ p ON p.symbol = m.symbol AND p.t = m.t)",
    }


#: Events stand for trades; their time is taken as local.
MINUTES = {"minutes_": "SELECT symbol, date_trunc('minute', ts) AS ts, min_by(usd + 1, event_id) AS open, max_by(usd + 1, event_id) AS close, count(*) AS volume FROM ev GROUP BY symbol, date_trunc('minute', ts)"}

SESSIONS: dict[str, str | tuple[str, dict[str, str]]] = {
    "agg_session_split": (
        f"SELECT symbol, day, is_late, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}, {r('quote_volume', 'quote_volume')}, {r('coalesce(ret_to_decision, 0)', 'ret_to_decision')} FROM split_",
        MINUTES | session_split(),
    ),
    "win_pct_rank_rolling": (f"SELECT symbol, t, {r('score', 'score')}, {r('pct', 'pct')}, hot FROM ranked_", rolling_rank()),
}
