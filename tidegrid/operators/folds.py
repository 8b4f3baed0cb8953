"""Ordered folds: operators whose state depends on the state before.

One group is one symbol (or one book of weekly bars, whose length is the calendar's).
Recursions run in numpy over Arrow batches; where DuckDB can recurse over the same
rows, the oracle does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.roster import MOM, RANKED, book
from ..plans.views import compose, duck
from ..plans.views import spark as spark_text
from ..sources.tables import query


def view(spark: SparkSession, sf_dir: str, body: str, extra: dict[str, str] | None = None) -> DataFrame:
    return query(spark, sf_dir, spark_text(compose(body, extra)))


def per_symbol(step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, body: str = "SELECT * FROM ret_1w") -> Callable[[SparkSession, str], DataFrame]:
    """step over each symbol's rows in the order of t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, body).groupBy("symbol").applyInPandas(lambda g: step(g.sort_values("t", kind="stable").reset_index(drop=True)), schema)

    return run


def ewm(x: np.ndarray, alpha: float, least: int = 1) -> np.ndarray:
    """Recursive mean seeded by the first value; missing values are skipped."""
    out, state, seen = np.full(len(x), np.nan), np.nan, 0
    for i, v in enumerate(x):
        if v == v:
            state = v if seen == 0 else (1 - alpha) * state + alpha * v
            seen += 1
        if seen >= least:
            out[i] = state
    return out


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder's smoothing: the mean of x[1..period] at row `period`, then a recursion."""
    out = np.full(len(x), np.nan)
    if len(x) > period:
        out[period] = x[1 : period + 1].mean()
        for i in range(period + 1, len(x)):
            out[i] = out[i - 1] + (x[i] - out[i - 1]) / period
    return out


def _present(g: pd.DataFrame) -> pd.DataFrame:
    return g[g.close.notna()].reset_index(drop=True)


def _ema(g: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"symbol": g.symbol, "t": g.t, "ema": np.round(ewm(g.close.to_numpy(float), 2 / 11), 6)})


def _rsi(g: pd.DataFrame, period: int = 14) -> pd.DataFrame:
    g = _present(g)
    change = np.diff(g.close.to_numpy(float), prepend=np.nan)
    up, down = wilder(np.clip(change, 0, None), period), wilder(np.clip(-change, 0, None), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down))
    return pd.DataFrame({"symbol": g.symbol, "t": g.t, "rsi": np.round(np.where(np.isnan(up), np.nan, rsi), 6)})


def rsi_setup(down_days: int = 3, multiple: float = 1.0, window: int = 20, period: int = 14, most: float = 30.0, hold: int = 5) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """fired: so many lower closes in a row, each on more than `multiple` of the mean volume before it, with Wilder's RSI below
    `most`; held: the last `hold` bars fired once at least. Rows without a close are left out."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = _present(g)
        rsi = _rsi(g, period).rsi.to_numpy(float)
        usual = g.volume.astype(float).shift(1).rolling(window).mean()
        both = (g.close.astype(float).diff() < 0) & (g.volume.astype(float) / usual > multiple)
        fired = (both.astype(float).rolling(down_days).sum() == down_days).to_numpy() & (rsi < most)
        held = pd.Series(fired.astype(float)).rolling(hold, min_periods=1).max()
        return pd.DataFrame({"symbol": g.symbol, "t": g.t, "fired": fired, "held": held.to_numpy()})

    return run


def fade(k: float = 1.5, h: int = 3) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """side -1 on the h bars from a standardised inflow z of k or more; what fires while one is held is passed over."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        z, side, free = g.z.to_numpy(float), np.zeros(len(g)), 0
        for i in np.flatnonzero(z >= k):
            if i >= free:
                side[i : i + h], free = -1.0, i + h
        return pd.DataFrame({"symbol": g.symbol, "t": g.t, "side": side})

    return run


def _atr(g: pd.DataFrame) -> pd.DataFrame:
    g = _present(g)
    before = g.close.shift(1)
    true = pd.concat([g.high - g.low, (g.high - before).abs(), (g.low - before).abs()], axis=1).max(axis=1)
    return pd.DataFrame({"symbol": g.symbol, "t": g.t, "atr": np.round(ewm(true.to_numpy(float), 1 / 14, 14), 6)})


def _hysteresis(g: pd.DataFrame) -> pd.DataFrame:
    """Carry: enter above one rate, leave below another."""
    on, out = False, []
    for rate in np.round(g.funding.to_numpy(float), 9):
        if rate == rate:
            on = rate > 0.12 if not on else rate > 0.06
        out.append(on)
    return pd.DataFrame({"symbol": g.symbol, "t": g.t, "held": np.array(out, float)})


def _split_adjust(g: pd.DataFrame) -> pd.DataFrame:
    """Prices before a jump of more than 4 (up or down) are scaled by it."""
    g = _present(g)
    price = g.close.to_numpy(float)
    jump = np.append(price[1:] / price[:-1], 1.0) if len(price) else price
    factor = np.where((jump > 4) | (jump < 0.25), jump, 1.0)
    scale = np.cumprod(factor[::-1])[::-1] if len(price) else price
    return pd.DataFrame({"symbol": g.symbol, "t": g.t, "adjusted": np.round(price * scale, 6)})


def _pairs(g: pd.DataFrame) -> pd.DataFrame:
    """A spread state machine on the z score of a log ratio: enter at 2, leave at 0.5."""
    x = np.log(g.a.to_numpy(float) / g.b.to_numpy(float))
    mean, sd = pd.Series(x).rolling(20).mean().to_numpy(), pd.Series(x).rolling(20).std(ddof=0).to_numpy()
    state, out = 0, []
    for v, m, s in zip(x, mean, sd, strict=True):
        z = (v - m) / s if s == s and s > 0 and v == v else np.nan
        if z == z:
            state = -1 if z > 2 else 1 if z < -2 else 0 if abs(z) < 0.5 else state
        out.append(state)
    return pd.DataFrame({"symbol": g.symbol, "t": g.t, "state": np.array(out, np.int64)})


PAIR = "SELECT 'Brand#11/Brand#12' AS symbol, x.t, x.close AS a, y.close AS b FROM panel_1w x JOIN panel_1w y ON x.t = y.t AND x.symbol = 'Brand#11' AND y.symbol = 'Brand#12'"


def ledger(g: pd.DataFrame, fee: float = 0.0012, cash: float = 100_000.0) -> pd.DataFrame:
    """One book through time: mark, pay what the last bar's orders cost, then trade to the targets decided one bar before."""
    held, price, pending, rows = {}, {}, 0.0, []
    wanted: dict[str, float] = {}
    for t, bar in g.sort_values(["t", "symbol"]).groupby("t", sort=True):
        now = {s: c for s, c in zip(bar.symbol, bar.close, strict=True) if c == c}
        for s in [s for s in held if s not in now]:  # no price: closed at the last one
            cash += held.pop(s) * price[s]
        price |= now
        cash -= pending
        nav = cash + sum(q * price[s] for s, q in held.items())
        pending = 0.0
        for s in sorted(set(held) | set(wanted)):
            if s in now:
                units = wanted.get(s, 0.0) * nav / now[s]
                traded = units - held.get(s, 0.0)
                cash -= traded * now[s]
                pending += abs(traded) * now[s] * fee
                held[s] = units
                if not units:
                    held.pop(s)
        rows.append((t, round(nav, 4), round(cash, 4), round(pending, 4), len(held)))
        raw = {s: v for s, v, c in zip(bar.symbol, bar.raw, bar.close, strict=True) if c == c and v == v and v}
        gross = sum(map(abs, raw.values()))
        wanted = {s: v / gross for s, v in raw.items()} if gross else {}
    return pd.DataFrame(rows, columns=["t", "nav", "cash", "fees", "positions"])


def slots(g: pd.DataFrame, n: int = 5, stay: int = 8) -> pd.DataFrame:
    """A book of n slots: the best unheld symbol takes a free slot; one leaves after `stay` bars or without a price."""
    book_: dict[str, int] = {}
    rows = []
    for t, bar in g.sort_values(["t", "symbol"]).groupby("t", sort=True):
        price = {s for s, c in zip(bar.symbol, bar.close, strict=True) if c == c}
        book_ = {s: k + 1 for s, k in book_.items() if s in price and k < stay}
        ranked = sorted((-(v), s) for s, v in zip(bar.symbol, bar.s, strict=True) if v == v and v > 0 and s in price and s not in book_)
        for _, s in ranked[: max(0, n - len(book_))]:
            book_[s] = 0
        rows += [(t, s, k) for s, k in sorted(book_.items())]
    return pd.DataFrame(rows, columns=["t", "symbol", "age"])


def whole_book(step: Callable, schema: str, body: str, extra: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """step over a whole book: weekly bars of the symbols (the state spans them, so the group is the book)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, body, extra).groupBy().applyInPandas(lambda g: step(g), schema)

    return run


def resampled(kind: str, draws: int = 200) -> Callable[[SparkSession, str], DataFrame]:
    """Null distributions of the momentum book's mean: draws are rows, spread over the cluster; each gets the short
    series of weekly returns (one value a week)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body, extra = book(f"SELECT *, CASE WHEN top <= 5 THEN 1.0 ELSE 0.0 END AS raw FROM ({RANKED.format(MOM)})", out="SELECT t, gross - cost AS net FROM bars_")
        series = view(spark, sf_dir, body, extra).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "net"))), lambda x: x["net"]).alias("x"))  # as long as the calendar

        def draw(batches):
            for g in batches:
                out = []
                for seed, x in zip(g.draw, g.x, strict=True):
                    x = np.asarray(x, float)
                    rng = np.random.default_rng(int(seed))
                    if kind == "bootstrap":  # stationary, mean block of 8
                        n = len(x)
                        at = np.empty(n, int)
                        k = 0
                        for i in range(n):
                            k = rng.integers(n) if i == 0 or rng.random() < 1 / 8 else (k + 1) % n
                            at[i] = k
                        y = x[at]
                    else:
                        y = x * rng.choice((-1.0, 1.0), len(x))
                    sd = y.std(ddof=1)
                    out.append((int(seed), float(y.mean()), float(y.mean() / sd * np.sqrt(52)) if sd else 0.0))
                yield pd.DataFrame(out, columns=["draw", "mean", "sharpe"])

        return spark.range(draws).withColumnRenamed("id", "draw").repartition(8).join(F.broadcast(series)).mapInPandas(draw, "draw long, mean double, sharpe double")

    return run


def bootstrap_means(returns: DataFrame, draws: int = 200, block: float = 8.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Means of every variant in every draw (draw, symbol, m), and each variant's n, f (its mean), w (deviation of its
    root-n mean over the draws) and the centres lower, consistent and upper.

    A draw is a stationary bootstrap of the calendar, as one count for each i, and is the same for all variants; draws
    are made on the executors and joined with the returns by i, so neither a matrix nor a draw of all variants is ever
    in one place. Variants without deviation are left out; a missing return counts as zero."""
    rows = returns.select("symbol", "i", F.coalesce("r", F.lit(0.0)).alias("r"))
    length = rows.agg((F.max("i") + 1).alias("n"))

    def draw(batches):
        for g in batches:
            for k, n in zip(g.draw, g.n, strict=True):
                if n != n:
                    continue
                n, rng = int(n), np.random.default_rng([seed, int(k)])
                fresh = rng.random(n) < 1 / block
                fresh[0] = True
                first = np.flatnonzero(fresh)
                run = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
                at = (np.repeat(rng.integers(0, n, len(first)), np.diff(np.append(first, n))) + run) % n
                i, times = np.unique(at, return_counts=True)
                yield pd.DataFrame({"draw": int(k), "i": i, "times": times})

    counts = returns.sparkSession.range(draws).withColumnRenamed("id", "draw").repartition(8).join(F.broadcast(length)).mapInPandas(draw, "draw long, i long, times long")
    own = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("f"), F.stddev_samp("r").alias("sd")).where("sd > 0")
    means = rows.join(counts, "i").groupBy("draw", "symbol").agg(F.sum(F.col("r") * F.col("times")).alias("total")).join(own, "symbol").withColumn("m", F.col("total") / F.col("n"))
    scale = means.groupBy("symbol").agg((F.stddev_samp("m") * F.sqrt(F.first("n"))).alias("w"), F.first("f").alias("f"), F.first("n").alias("n")).where("w > 0")
    low = -F.col("w") / F.sqrt("n") * F.sqrt(2 * F.log(F.log(F.col("n").cast("double"))))
    scale = scale.select("symbol", "w", "f", "n", F.greatest("f", F.lit(0.0)).alias("lower"), F.when(F.col("f") >= low, F.col("f")).otherwise(0.0).alias("consistent"), F.col("f").alias("upper"))
    return means.select("draw", "symbol", "m"), scale


def spa(returns: DataFrame, draws: int = 200, block: float = 8.0, seed: int = 42) -> DataFrame:
    """Superior predictive ability (Hansen) of variants against zero: symbol, i (0, 1, ... for each variant), r.

    One row: n, variants, statistic and p_lower, p_consistent, p_upper."""
    means, scale = bootstrap_means(returns, draws, block, seed)
    top = scale.agg(F.greatest(F.max(F.sqrt("n") * F.col("f") / F.col("w")), F.lit(0.0)).alias("statistic"), F.count("*").alias("variants"), F.max("n").alias("n"))
    null = means.join(scale, "symbol").groupBy("draw").agg(*(F.greatest(F.max(F.sqrt("n") * (F.col("m") - F.col(c)) / F.col("w")), F.lit(0.0)).alias(c) for c in ("lower", "consistent", "upper")))
    share = lambda c: F.avg(F.when(F.col(c) > F.col("statistic"), 1.0).otherwise(0.0)).alias(f"p_{c}")
    return null.join(F.broadcast(top)).groupBy("n", "variants", "statistic").agg(share("lower"), share("consistent"), share("upper"))


FLOWS = "SELECT symbol, day AS t, (usd - avg(usd) OVER w) / nullif(stddev_samp(usd) OVER w, 0) AS z FROM (SELECT symbol, day, sum(usd) AS usd FROM ev GROUP BY symbol, day) WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def _rsi_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setup's book: symbols held have equal shares of each bar."""
    held = per_symbol(rsi_setup(most=45.0), "symbol string, t date, fired boolean, held double", "SELECT symbol, t, close, volume FROM bars_1d")(spark, sf_dir)
    all_ = F.sum("held").over(Window.partitionBy("t"))
    return held.select("symbol", "t", "fired", F.when(all_ > 0, F.col("held") / all_).otherwise(0.0).alias("w"))


def _spa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spa(view(spark, sf_dir, "SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM ret_1w"))


LEDGER = book(f"SELECT *, CASE WHEN top <= 5 THEN 1.0 ELSE 0.0 END AS raw FROM ({RANKED.format(MOM)})", out="SELECT symbol, t, close, raw FROM masked_")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "win_ema": per_symbol(_ema, "symbol string, t date, ema double"),
    "win_rsi": per_symbol(_rsi, "symbol string, t date, rsi double"),
    "sig_rsi_reversal": _rsi_reversal,
    "sig_inflow_fade": per_symbol(fade(), "symbol string, t date, side double", FLOWS),
    "win_atr": per_symbol(_atr, "symbol string, t date, atr double"),
    "win_split_adjust": per_symbol(_split_adjust, "symbol string, t date, adjusted double"),
    "sig_carry_hysteresis": per_symbol(_hysteresis, "symbol string, t date, held double"),
    "sig_pairs": per_symbol(_pairs, "symbol string, t date, state long", PAIR),
    "bt_ledger": whole_book(ledger, "t date, nav double, cash double, fees double, positions long", *LEDGER),
    "bt_slots": whole_book(slots, "t date, symbol string, age long", f"SELECT m.symbol, m.t, m.s, p.close FROM ({MOM}) m JOIN ret_1w p ON p.symbol = m.symbol AND p.t = m.t"),
    "st_bootstrap": resampled("bootstrap"),
    "st_permutation": resampled("permutation"),
    "st_spa": _spa,
}

#: The recursions in SQL, over the same dense rows.
_EMA = """
WITH RECURSIVE {views}, x AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ret_1w),
f AS (SELECT symbol, t, i, close AS e FROM x WHERE i = 1
  UNION ALL SELECT x.symbol, x.t, x.i, CASE WHEN x.close IS NULL THEN f.e WHEN f.e IS NULL THEN x.close ELSE f.e * 9.0::DOUBLE / 11 + x.close * 2.0::DOUBLE / 11 END FROM f JOIN x ON x.symbol = f.symbol AND x.i = f.i + 1)
SELECT symbol, t, round(e, 6) + 0.0 AS ema FROM f"""
_HYST = """
WITH RECURSIVE {views}, x AS (SELECT symbol, t, round(funding, 9) AS funding, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ret_1w),
f AS (SELECT symbol, t, i, coalesce(funding > 0.12, false) AS h FROM x WHERE i = 1
  UNION ALL SELECT x.symbol, x.t, x.i, CASE WHEN x.funding IS NULL THEN f.h WHEN f.h THEN x.funding > 0.06 ELSE x.funding > 0.12 END FROM f JOIN x ON x.symbol = f.symbol AND x.i = f.i + 1)
SELECT symbol, t, CASE WHEN h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS held FROM f"""
_VIEWS = duck(compose("SELECT 1 FROM ret_1w")).removeprefix("WITH ").removesuffix("SELECT 1 FROM ret_1w").strip()
ORACLE_SQL: dict[str, str] = {"win_ema": _EMA.format(views=_VIEWS), "sig_carry_hysteresis": _HYST.format(views=_VIEWS)}
