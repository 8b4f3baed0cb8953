"""Streams with state by key: duplicates, sessions and changes, each within a stated lateness.

Events may arrive in any order as long as none is older than the watermark (the latest
time seen, less `late`); older ones are dropped, which is what bounds the state. Rows
come out when the watermark has passed them, so their order and content do not depend on
how events were split into files and micro-batches.

`replayed` runs such a stream over the files that are there: first as a stream, then once
more from its checkpoint with a last event far in the future, whose watermark closes what
is still open. State is in RocksDB; the sink writes each micro-batch once.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared

LATE, GAP, SLICE = "30 days", "60 seconds", "60 seconds"
END = "2200-01-01"
CLOSING = "(end)"  # the key of the event that closes a replay
EVENT = "event_id long, ts timestamp, symbol string, owner long, usd double, k int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def events(spark: SparkSession, sf_dir: str, files: int = 1000) -> DataFrame:
    """The event files as a stream, `files` of them in a micro-batch at most."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events*.parquet")
    return stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("user_id").cast("long").alias("owner"), F.col("value").cast("double").alias("usd"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def once(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once, though it may be delivered again while it is within the lateness."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(stream: DataFrame, gap: str = GAP) -> DataFrame:
    """symbol, first, last, n, usd of runs of events that follow each other within `gap`, the gap itself included. stream: with a watermark."""
    return stream.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("usd").alias("usd")).drop("w")


class Changes(StatefulProcessor):
    """The changes of a key, from its slices of time: each with its first and last value and the event_ids of the changes within.

    Slices come when the watermark has passed them, so those of one micro-batch follow all earlier ones. Event_ids
    within a slice go out as it is read; of every slice only its start, first event and two values are kept until the
    micro-batch has been read. State: the last value given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "k int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ends = []
        for r in rows:
            ends.append((r.start, r.event_id, r.first, r.last))
            if r.inner:
                yield Row(symbol=key[0], event_ids=r.inner)
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        for _, event_id, first, after in sorted(ends, key=lambda e: e[0]):
            if not known or first != last:
                yield Row(symbol=key[0], event_ids=[event_id])
            known, last = True, after
        if ends:
            self.last.update((last,))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, slice_: str = SLICE) -> DataFrame:
    """symbol, event_id of events whose k differs from that of the symbol's event before; equal times go by event_id, k is not null. stream: with a watermark on ts.

    Events are sorted within slices of time, so no task has a symbol's whole stream in one list: Python gets arrays of
    event_ids and a few values a slice."""
    slices = stream.groupBy("symbol", F.window("ts", slice_).alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "k"))).alias("e"))
    changed = F.transform("e", lambda x, i: F.when((i > 0) & (x["k"] != F.get("e", i - 1)["k"]), x["event_id"]))
    ends = slices.select("symbol", F.window_time("w").alias("ts"), F.unix_micros(F.col("w.start")).alias("start"), F.col("e")[0]["event_id"].alias("event_id"), F.col("e")[0]["k"].alias("first"), F.element_at("e", -1)["k"].alias("last"), F.array_compact(changed).alias("inner"))
    found = ends.groupBy("symbol").transformWithState(Changes(), "symbol string, event_ids array<long>", "append", "eventTime")
    return found.select("symbol", F.explode("event_ids").alias("event_id"))


@contextlib.contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def replayed(stream: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """step over the stream's files until nothing is open. step: stream to rows in append mode, with the column symbol."""
    spark = stream.sparkSession
    out = shared(spark, name)
    spark.createDataFrame([], EVENT).write.parquet(f"{out}/closing")
    closing = spark.readStream.schema(EVENT).parquet(f"{out}/closing")
    rows = step(stream.unionByName(closing)).where(F.col("symbol") != CLOSING)
    with _rocksdb(spark):
        for last in (False, True):
            if last:
                spark.range(1).selectExpr("CAST(-1 AS LONG) AS event_id", f"TIMESTAMP '{END}' AS ts", f"'{CLOSING}' AS symbol", "CAST(-1 AS LONG) AS owner", "CAST(0 AS DOUBLE) AS usd", "0 AS k").write.mode("append").parquet(f"{out}/closing")
            run = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events by type; every event is delivered twice and counts once."""
    twice = events(spark, sf_dir).unionByName(events(spark, sf_dir))
    rows = replayed(twice, lambda s: sessions(once(s)), "sessions")
    return rows.select("symbol", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n", (F.round("usd", 6) + 0.0).alias("usd"))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = events(spark, sf_dir).unionByName(events(spark, sf_dir))
    return replayed(twice, lambda s: once(s).select("symbol", "event_id", "owner"), "once").select("event_id", "symbol", "owner")


def stream_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(events(spark, sf_dir), lambda s: changes(s.withWatermark("ts", LATE)), "compact").select("event_id", "symbol")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_sessions": stream_sessions, "stream_once": stream_once, "stream_compact": stream_compact}
ORACLE_SQL = {
    "stream_sessions": """
SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 6) + 0.0 AS usd FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT event_type AS symbol, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) <= 60000000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY symbol, session""",
    "stream_once": "SELECT event_id, event_type AS symbol, user_id AS owner FROM events",
    "stream_compact": """
SELECT event_id, symbol FROM (SELECT *, lag(k) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before
  FROM (SELECT event_id, event_type AS symbol, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)) WHERE before IS NULL OR k <> before""",
}
