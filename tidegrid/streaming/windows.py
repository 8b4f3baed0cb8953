"""Event streams with Structured Streaming: the streaming forms of the str_ queries.

The source is a folder (or glob) of event files. Every micro-batch aggregates its own
rows, and writes these partial sums to the folder executors share; the sums of all
batches are the result. No event is too late for them, so a run that is repeated or split
into other micro-batches, in whatever order files arrive, ends with the rows of the batch
form. `watermarked` is the form for streams that never end: its state is bounded by
`LATE`, and later events are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared

LATE = "2 hours"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events*.parquet")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("user_id").alias("owner"), F.col("value").alias("usd"))


def watermarked(stream: DataFrame, width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """symbol, w, usd, n of every window, with state that events older than `late` no longer reach."""
    return stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.sum("usd").alias("usd"), F.count("*").alias("n"))


def summed(spark: SparkSession, stream: DataFrame, width: str, slide: str | None, name: str) -> DataFrame:
    """Runs the stream over what is there: symbol, w, usd, n of every window."""
    out = shared(spark, name)

    def keep(batch: DataFrame, epoch: int) -> None:  # an epoch that is repeated writes the same folder again
        sums = batch.groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.sum("usd").alias("usd"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/data/batch={epoch}")

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    parts = spark.read.parquet(f"{out}/data")
    return parts.groupBy("symbol", "w").agg(F.sum("usd").alias("usd"), F.sum("n").alias("n"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summed(spark, events(spark, sf_dir), "1 hour", None, "tumbling")
    return rows.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("hour"), (F.round("usd", 6) + 0.0).alias("usd"), "n")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summed(spark, events(spark, sf_dir), "6 hours", "1 hour", "sliding")
    return rows.select("symbol", F.col("w.end").cast("timestamp_ntz").alias("until"), (F.round("usd", 6) + 0.0).alias("usd"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_tumbling": tumbling, "stream_sliding": sliding}
_EV = "(SELECT ts, event_type AS symbol, value AS usd FROM events)"
ORACLE_SQL = {
    "stream_tumbling": f"SELECT symbol, date_trunc('hour', ts) AS hour, round(sum(usd), 6) + 0.0 AS usd, count(*) AS n FROM {_EV} GROUP BY ALL",
    "stream_sliding": f"SELECT symbol, until, round(sum(usd), 6) + 0.0 AS usd, count(*) AS n FROM (SELECT symbol, usd, date_trunc('hour', ts) + to_hours(CAST(k AS INT)) AS until FROM {_EV}, range(1, 7) r(k)) GROUP BY ALL",
}
