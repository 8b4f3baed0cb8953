"""Regressions from sums: factor models with robust errors, and ridge forecasts refitted over time.

The rows are aggregated once into sums of products; what is solved is as large as the
number of factors. Solving runs in tasks, a key or a fold a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import view


def _products(columns: list[Column]) -> Column:
    """The sums of all products of the columns, as one array in row order."""
    return F.array(*(F.sum(a * b) for a in columns for b in columns))


def _square(values: object, size: int) -> np.ndarray:
    return np.asarray(values, float).reshape(size, size)


def ols_hac(rows: DataFrame, factors: list[str], *, key: str = "symbol", time: str = "t", y: str = "y", per_year: float = 52.0, lags: int | None = None, least: int = 30) -> DataFrame:
    """Ordinary least squares of y on the factors for each key, with Newey-West errors.

    A row for the constant (term alpha) and each factor: key, n, lags, term, estimate, se, t_stat, p_value, r_squared,
    information_ratio. Rows with a null are left out; keys with fewer than `least` rows give none. lags: by default
    floor(4 * (n / 100) ** (2 / 9)); Bartlett weights, errors scaled by n / (n - parameters), p from the normal.
    The alpha is per row; its information ratio is annualised by per_year. Scores meet their lagged ones by (key,
    number), so a key's products are spread over tasks; only their sums are solved."""
    k = len(factors) + 1
    names = ["alpha", *factors]
    held = rows.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(y).cast("double").alias("y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(factors, 1))).dropna()
    design = [F.lit(1.0), *(F.col(f"x{i}") for i in range(1, k))]
    sums = held.groupBy("key").agg(F.count("*").alias("n"), _products([*design, F.col("y")]).alias("g"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, n, g in zip(batch.key, batch.n, batch.g, strict=True):
                if n < least:
                    continue
                whole = _square(g, k + 1)
                beta = np.linalg.pinv(whole[:k, :k]) @ whole[:k, k]
                sse, mean = whole[k, k] - beta @ whole[:k, k], whole[0, k] / n
                wide = math.floor(4 * (n / 100) ** (2 / 9)) if lags is None else lags
                out.append((name, n, max(0, min(wide, n - k - 1)), beta.tolist(), whole[:k, :k].ravel().tolist(), max(sse, 0.0), whole[k, k] - n * mean * mean))
            yield pd.DataFrame(out, columns=["key", "n", "lags", "beta", "xx", "sse", "sst"])

    fitted = sums.mapInPandas(solve, "key string, n long, lags int, beta array<double>, xx array<double>, sse double, sst double")
    joined = held.join(fitted.select("key", "lags", "beta"), "key").withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("t")))
    residual = F.col("y") - sum((F.col("beta")[j] * d for j, d in enumerate(design)), F.lit(0.0))
    scores = joined.withColumn("e", residual).select("key", "i", "lags", *((d * F.col("e")).alias(f"u{j}") for j, d in enumerate(design)))
    ahead = scores.select("key", F.explode(F.sequence(F.lit(0), "lags")).alias("lag"), "i", *(F.col(f"u{j}").alias(f"v{j}") for j in range(k))).withColumn("i", F.col("i") + F.col("lag"))
    crossed = ahead.join(scores.drop("lags"), ["key", "i"]).groupBy("key", "lag").agg(F.array(*(F.sum(F.col(f"u{a}") * F.col(f"v{b}")) for a in range(k) for b in range(k))).alias("s"))
    meat = crossed.groupBy("key").agg(F.collect_list(F.struct("lag", "s")).alias("meat"))  # a few lags

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                middle = np.zeros((k, k))
                for part in row.meat:
                    g = _square(part["s"], k)
                    middle += g if part["lag"] == 0 else (1 - part["lag"] / (row.lags + 1)) * (g + g.T)
                bread = np.linalg.pinv(_square(row.xx, k))
                se = np.sqrt(np.maximum(np.diag(bread @ middle @ bread) * row.n / (row.n - k), 0))
                sd = math.sqrt(row.sse / (row.n - 1))
                for j, name in enumerate(names):
                    t = row.beta[j] / se[j] if se[j] > 0 else math.nan
                    ratio = row.beta[0] / sd * math.sqrt(per_year) if sd > 0 else math.nan
                    out.append((row.key, row.n, row.lags, name, row.beta[j], se[j], t, math.erfc(abs(t) / math.sqrt(2)), 1 - row.sse / row.sst if row.sst > 0 else math.nan, ratio))
            yield pd.DataFrame(out, columns=["key", "n", "lags", "term", "estimate", "se", "t_stat", "p_value", "r_squared", "information_ratio"])

    return fitted.join(meat, "key").mapInPandas(finish, "key string, n long, lags int, term string, estimate double, se double, t_stat double, p_value double, r_squared double, information_ratio double").withColumnRenamed("key", key)


def walk_forward_ridge(rows: DataFrame, features: list[str], *, time: str = "t", y: str = "y", penalty: float = 1.0, purge_days: int = 7, least: int = 250) -> DataFrame:
    """rows with fold (its month), pred and base: ridge forecasts of y, refitted each month on all rows that end at least
    purge_days before it.

    y of a row is known later than the row; purge_days must cover that, so no fit sees what its month would bring. Rows
    are summed by day once; a fold adds the days before its cut (a join of the calendar with its months, which does
    not grow with the rows), is standardised by its own means and deviations, and solved in closed form with a free
    constant. base is the mean of y in the fit. Rows with a null, months whose fit has fewer than `least` rows, and
    the rows before, get no forecast and are left out."""
    k = len(features)
    clean = rows.dropna(subset=[time, y, *features])
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(y).cast("double")]
    days = clean.groupBy(F.to_date(time).alias("day")).agg(_products(columns).alias("g"))
    months = clean.select(F.to_date(F.date_trunc("month", time)).alias("fold")).distinct()
    size = (k + 2) ** 2
    fits = months.join(days, F.col("day") <= F.date_sub("fold", purge_days + 1)).groupBy("fold").agg(F.array(*(F.sum(F.col("g")[j]) for j in range(size))).alias("g"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fold, g in zip(batch.fold, batch.g, strict=True):
                g = _square(g, k + 2)
                n = g[0, 0]
                if n < least:
                    continue
                mean, target = g[0, 1 : k + 1] / n, g[0, k + 1] / n
                centred = g[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(centred), 0) / n)
                sd[sd < 1e-12] = 1.0
                z, zy = centred / np.outer(sd, sd), (g[1 : k + 1, k + 1] - n * mean * target) / sd
                slope = np.linalg.solve(z + penalty * np.eye(k), zy) / sd
                out.append((fold, target, [target - slope @ mean, *slope]))
            yield pd.DataFrame(out, columns=["fold", "base", "b"])

    solved = fits.mapInPandas(solve, "fold date, base double, b array<double>")
    test = clean.withColumn("fold", F.to_date(F.date_trunc("month", time)))
    pred = F.col("b")[0] + sum((F.col("b")[j] * F.col(f) for j, f in enumerate(features, 1)), F.lit(0.0))
    return test.join(F.broadcast(solved), "fold").withColumn("pred", pred).drop("b")  # a row a month


_MARKET = "SELECT t, avg(r) AS mkt, avg(CASE WHEN half = 1 THEN r END) - avg(CASE WHEN half = 2 THEN r END) AS size, avg(funding) AS carry FROM (SELECT *, ntile(2) OVER (PARTITION BY t ORDER BY quote_volume DESC, symbol) AS half FROM ret_1w WHERE r IS NOT NULL) GROUP BY t"
FACTORS = f"SELECT a.symbol, a.t, a.r AS y, m.mkt, m.size, m.carry FROM ret_1w a JOIN ({_MARKET}) m ON m.t = a.t"
FEATURES = """
SELECT symbol, t, lead(r) OVER w AS y, r AS x1, sum(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x4,
  stddev_samp(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS vol, funding, ln(quote_volume) AS size
FROM ret_1w WINDOW w AS (PARTITION BY symbol ORDER BY t)"""


def _ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols_hac(view(spark, sf_dir, FACTORS), ["mkt", "size", "carry"])


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_forward_ridge(view(spark, sf_dir, FEATURES), ["x1", "x4", "vol", "funding", "size"]).select("symbol", "t", "fold", "y", "base", "pred")


def positions(entry: float = 2.0, exit_z: float = 0.5, max_hold: int = 10) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A pair's position (1: long a and short b) through time from its z scores: opened beyond entry, closed within exit_z,
    after max_hold bars or without a price; a bar that closes stays flat."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").reset_index(drop=True)
        state, held, out = 0.0, 0, []
        for z, priced in zip(g.z.to_numpy(float), g.priced, strict=True):
            if state:
                held += 1
                if (z == z and abs(z) <= exit_z) or held >= max_hold or not priced:
                    state, held = 0.0, 0
                    out.append(0.0)
                    continue
            elif z == z and abs(z) >= entry:
                state, held = -math.copysign(1.0, z), 0
            out.append(state)
        return pd.DataFrame({"k": g.k, "a": g.a, "b": g.b, "t": g.t, "side": out, "beta": g.beta})

    return run


def pair_book(scores: DataFrame, most: int = 10, gross: float = 1.0, **rule: float) -> DataFrame:
    """symbol, t, w: the book of up to `most` open pairs a bar, in their order k; scores: k, a, b, t, priced, beta, z.

    A pair has an equal share, split between its legs by its hedge ratio (1 while it does not revert); the bar's weights
    are scaled to `gross`."""
    held = scores.groupBy("k").applyInPandas(positions(**rule), "k int, a string, b string, t date, side double, beta double").where("side <> 0")
    bar = Window.partitionBy("t")
    live = held.withColumn("place", F.row_number().over(bar.orderBy("k"))).where(F.col("place") <= most).withColumn("share", 1 / F.count("*").over(bar)).withColumn("h", F.coalesce("beta", F.lit(1.0)))
    legs = live.select("t", F.explode(F.array(F.struct(F.col("a").alias("symbol"), (F.col("side") * F.col("share") / (1 + F.col("h"))).alias("w")), F.struct(F.col("b").alias("symbol"), (-F.col("side") * F.col("share") * F.col("h") / (1 + F.col("h"))).alias("w")))).alias("x"))
    net = legs.groupBy("t", "x.symbol").agg(F.sum("x.w").alias("w"))
    return net.withColumn("all", F.sum(F.abs("w")).over(bar)).select("symbol", "t", F.when(F.col("all") > 0, F.col("w") * gross / F.col("all")).otherwise(0.0).alias("w"))


def _pair_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.spreads import pair_zscores

    views = pair_zscores()[1]
    held = pair_book(view(spark, sf_dir, "SELECT CAST(k AS INT) AS k, a, b, t, priced, beta, z FROM pairs_z_", views))
    return view(spark, sf_dir, "SELECT symbol, t FROM panel_1w").join(held, ["symbol", "t"], "left").select("symbol", "t", F.coalesce("w", F.lit(0.0)).alias("w"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"st_ols_hac": _ols, "st_walk_forward_ridge": _forecast, "sig_perp_pairs": _pair_book}
