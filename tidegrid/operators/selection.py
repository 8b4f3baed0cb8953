"""What a search over variants has found: step-down tests and the number of independent trials."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .folds import bootstrap_means, view

#: Variants or bars, whichever are fewer, may be so many: their Gram matrix is one task's
MOST = 4096
VARIANTS = """
SELECT concat(symbol, '/', CAST(k AS VARCHAR(10))) AS symbol, i, r FROM (
  SELECT symbol, k, row_number() OVER (PARTITION BY symbol, k ORDER BY t) - 1 AS i,
    r * lag(CASE k WHEN 4 THEN s4 WHEN 8 THEN s8 WHEN 12 THEN s12 ELSE s26 END) OVER (PARTITION BY symbol, k ORDER BY t) AS r
  FROM (SELECT symbol, t, r, {signs} FROM ret_1w WINDOW w AS (PARTITION BY symbol ORDER BY t)) CROSS JOIN (SELECT 4 AS k UNION ALL SELECT 8 UNION ALL SELECT 12 UNION ALL SELECT 26) g)
""".format(signs=", ".join(f"sign(round(close / nullif(lag(close, {k}) OVER w, 0) - 1, 12)) AS s{k}" for k in (4, 8, 12, 26)))


def studentised(returns: DataFrame, draws: int = 200, block: float = 8.0, seed: int = 42) -> DataFrame:
    """draw, symbol, z (the variant's centred mean in the draw) and statistic, both root-n means over their deviation.

    Means are centred as Hansen's consistent test does: a variant far below zero is not centred."""
    means, scale = bootstrap_means(returns, draws, block, seed)
    root = F.sqrt(F.col("n").cast("double")) / F.col("w")
    return means.join(scale, "symbol").select("draw", "symbol", (root * (F.col("m") - F.col("consistent"))).alias("z"), (root * F.col("f")).alias("statistic"))


def step_down(null: DataFrame, size: float = 0.05) -> DataFrame:
    """Romano and Wolf's step-down test on a table of studentised draws: symbol, statistic, step (the round that rejected
    zero for the variant; null: none did) and critical (that round's, or the last one's).

    A round's critical value is the (1 - size) quantile over draws of the largest z among the variants still left; those
    above it are rejected and leave, until a round rejects none. The table is written once; a round is two
    aggregations and an anti-join with the variants that left, and only its count and quantile reach the driver."""
    null = kept(null, "studentised")
    own = null.select("symbol", "statistic").distinct()
    out, k = None, 0
    while True:
        k += 1
        left, mine = (null, own) if out is None else (x.join(out.select("symbol"), "symbol", "left_anti") for x in (null, own))
        tops = left.groupBy("draw").agg(F.max("z").alias("top"))
        critical = tops.agg(F.percentile("top", F.lit(1 - size)).alias("c")).first()["c"]
        if critical is None:
            break
        fresh = mine.where(F.col("statistic") > critical).select("symbol", "statistic", F.lit(k).cast("long").alias("step"), F.lit(critical).alias("critical"))
        grown = kept(fresh if out is None else out.unionByName(fresh), "rejected")
        before = 0 if out is None else out.count()
        out = grown
        if grown.count() == before:
            break
    rest = own.join(out.select("symbol"), "symbol", "left_anti") if out is not None else own
    last = rest.select("symbol", "statistic", F.lit(None).cast("long").alias("step"), F.lit(critical).cast("double").alias("critical"))
    return last if out is None else out.unionByName(last)


def effective_trials(returns: DataFrame, floor: int = 1) -> DataFrame:
    """One row: raw (variants), entropy_rank (exp of the entropy of the correlation matrix's normalised eigenvalues) and
    effective (rounded, between floor and raw). returns: symbol, i, r.

    Missing returns count as zero, variants without any are left out, and those without deviation correlate with
    nothing. The matrix of variants and that of bars have the same eigenvalues but for zeros, so the smaller is made:
    rows are dealt by the other side, each task adds up its products, and one task adds the sums and takes the
    eigenvalues. It is an error if both sides exceed MOST."""
    rows = returns.where("r IS NOT NULL").select(F.col("symbol").alias("v"), "i", "r")
    bars = returns.agg(F.countDistinct("i")).first()[0]
    sums = rows.groupBy("v").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    sums = kept(sums.select("v", (F.col("s") / bars).alias("mean"), F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / bars, F.lit(0.0))).alias("length"), (F.row_number().over(Window.orderBy("v")) - 1).alias("column")), "variants") if bars else None
    raw = sums.count() if bars else 0
    spark = returns.sparkSession
    if raw < 2:
        return spark.createDataFrame([(raw, float(raw), max(floor, raw))], "raw long, entropy_rank double, effective long")
    if min(raw, bars) > MOST:
        raise ValueError(f"{raw} variants over {bars} bars: the smaller side may have {MOST}")
    by_bar = raw <= bars
    width = raw if by_bar else bars
    calendar = returns.select("i").distinct().withColumn("row", F.row_number().over(Window.orderBy("i")) - 1)
    z = F.when(F.col("length") > 1e-12, (F.coalesce("r", F.lit(0.0)) - F.col("mean")) / F.col("length")).otherwise(0.0)
    cells = sums.join(calendar).join(rows, ["v", "i"], "left").select("row", "column", z.alias("z"))  # dense: an absent return is zero before its mean is taken
    outer, inner = ("row", "column") if by_bar else ("column", "row")
    vectors = cells.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, "z"))).alias("x")).select(outer, F.transform("x", lambda c: c["z"]).alias("x"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            gram = x.T @ x if gram is None else gram + x.T @ x
        if gram is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(gram))], ["k", "g"])

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            np.add.at(gram, batch.column("k").to_numpy(), batch.column("g").flatten().to_numpy().reshape(-1, width))
        values = np.linalg.eigvalsh(gram)
        values = values[values > 1e-12]
        share = values / values.sum()
        rank = float(np.exp(-(share * np.log(share)).sum())) if len(values) else float(floor)
        yield pa.RecordBatch.from_arrays([pa.array([raw]), pa.array([rank]), pa.array([int(max(floor, min(raw, round(rank))))])], ["raw", "entropy_rank", "effective"])

    partial = vectors.repartition(8, outer).mapInArrow(products, "k long, g array<double>")
    return partial.coalesce(1).mapInArrow(spectrum, "raw long, entropy_rank double, effective long")


def _step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_down(studentised(view(spark, sf_dir, VARIANTS)))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_trials(view(spark, sf_dir, VARIANTS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"st_step_down": _step_down, "st_effective_trials": _effective}
