"""Named views of the market model, as SQL fragments that compose into one plan.

A view is a SELECT over tables or other views. `compose` puts the views a query names
(and theirs) before it as common table expressions, so Catalyst sees one plan: it
prunes columns, pushes filters into the scans and reuses exchanges. The text is in
Spark's dialect; `duck` gives the same statement in DuckDB's, for the oracle.
"""

from __future__ import annotations

import re

TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


def _bars(unit: str) -> str:
    """One aggregation: the first and last prints by day and tie-break, no sort of all prints by window."""
    return f"""
SELECT symbol, t, min_by(price, struct(day, {TIES})) AS open, max(price) AS high, min(price) AS low, max_by(price, struct(day, {TIES})) AS close,
  sum(qty) AS volume, sum(usd) AS quote_volume, count(*) AS trades, sum(l_tax) AS funding
FROM (SELECT *, CAST(date_trunc('{unit}', day) AS DATE) AS t FROM prints) GROUP BY symbol, t"""


def _grid(bars: str, unit: str) -> str:
    """Times and symbols come from the prints, so bars are made once."""
    return f"""
SELECT s.symbol, d.t, b.open, b.high, b.low, b.close, b.volume, b.quote_volume, b.trades, b.funding
FROM (SELECT DISTINCT symbol FROM prints) s CROSS JOIN (SELECT DISTINCT CAST(date_trunc('{unit}', day) AS DATE) AS t FROM prints) d LEFT JOIN {bars} b ON b.symbol = s.symbol AND b.t = d.t"""


VIEWS = {
    "prints": "SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS qty, l_extendedprice AS usd, "
    f"{TIES} FROM lineitem JOIN part ON l_partkey = p_partkey",
    "bars_1d": _bars("day"),
    "bars_1w": _bars("week"),
    # Dense grids: every symbol at every time; absent bars stay NULL, nothing is filled.
    "panel_1d": _grid("bars_1d", "day"),
    "panel_1w": _grid("bars_1w", "week"),
    "ret_1w": "SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS r FROM panel_1w",
    "ret_1d": "SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS r FROM panel_1d",
    "ev": "SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type AS symbol, user_id AS owner, value AS usd, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events",
    "ev_1h": "SELECT symbol, date_trunc('hour', ts) AS t, sum(usd) AS usd, count(*) AS n, max(usd) AS peak FROM ev GROUP BY symbol, date_trunc('hour', ts)",
    "filings": "SELECT o_orderkey AS filing, o_custkey AS owner, CAST(o_orderdate AS DATE) AS event_day, date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 5 AS INT)) AS published, o_totalprice AS value, o_orderstatus AS status FROM orders",
    "rates": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, avg(l_discount) AS rate FROM lineitem GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE)",
}


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """body with the views that it uses, however deep, before it."""
    known, order = VIEWS | (extra or {}), []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in order) + "\n" if order else "") + body.strip()


_DUCK = (
    (r"\bcount_le\((\w+), (\w+)\)", r"len(list_filter(\1, lambda x: x <= \2))"),
    (r"\bcount_lt\((\w+), (\w+)\)", r"len(list_filter(\1, lambda x: x < \2))"),
    (r"\bhex_long\((\w+), (\d+), (\d+)\)", r"CAST(concat('0x', substr(\1, \2, \3)) AS BIGINT)"),
    (r"\bpercentile\(", "quantile_cont("), (r"\bget_json_object\(", "json_extract_string("), (r"\bcollect_list\(", "list("), (r"\bsha2\(", "sha256("), (r", 256\)", ")"),
    (r"\bdate_add\(([^()]*(?:\([^()]*\)[^()]*)*), (CAST\([^()]*\)|\d+)\)", r"(\1 + \2)"), (r"\bdatediff\(DAY, ", "datediff('day', "), (r"\bdayofweek_iso\(", "isodow("), (r"\barray_join\(", "array_to_string("),
    (r"\bunix_micros\(CAST\((\w+) AS TIMESTAMP\)\)", r"epoch_us(\1)"), (r"\bmax_by\(", "arg_max("), (r"\bmin_by\(", "arg_min("), (r"\bstruct\(", "row("), (r"\barray_sort\(", "list_sort("),
)


def duck(sql: str) -> str:
    for found, instead in _DUCK:
        sql = re.sub(found, instead, sql)
    return sql


def spark(sql: str) -> str:
    """Spark reads 1.5 as a decimal; the model's literals are doubles. Some operators have other names."""
    for found, instead in ((" // ", " div "), ("last_value(", "last("), ("first_value(", "first("), (" IGNORE NULLS)", ", true)")):
        sql = sql.replace(found, instead)
    sql = re.sub(_DUCK[0][0], r"size(filter(\1, x -> x <= \2))", sql)
    sql = re.sub(_DUCK[1][0], r"size(filter(\1, x -> x < \2))", sql)
    sql = re.sub(_DUCK[2][0], r"CAST(conv(substr(\1, \2, \3), 16, 10) AS BIGINT)", sql)
    return re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\w.])", r"\1D", sql)
