"""Hash-chained logs: sealing records and verifying chains.

A record's hash covers its number, time, kind, subject, payload and the hash of the record
before it, each with its length, so no byte can move from one field to another. Sealing
has to follow the chain: a chain is read in order by one task, which keeps nothing but
the last hash. Verifying does not: each record is checked alone, and joined with the
record of the number before it by (chain, number), so one long chain is spread over all
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept
from .folds import view

GENESIS = "0" * 64
BODY = ("seq", "ts", "kind", "subject", "payload", "prev_hash")
SEALED = "chain string, seq long, ts long, kind string, subject string, payload string, prev_hash string, hash string"


def record_hash() -> Column:
    """SHA-256 of a record's body; a null field is a dash."""
    sized = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(sized(F.col(c).cast("string")) for c in BODY)).cast("binary"), 256)


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain, seq, last = None, 0, GENESIS
    for batch in batches:
        rows = []
        for name, ts, kind, subject, payload in zip(*(batch.column(c).to_pylist() for c in ("chain", "ts", "kind", "subject", "payload")), strict=True):
            if name != chain:
                chain, seq, last = name, 0, GENESIS
            text = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (seq, ts, kind, subject, payload, last))
            before, last = last, hashlib.sha256(text.encode()).hexdigest()
            rows.append((name, seq, ts, kind, subject, payload, before, last))
            seq += 1
        types = [pa.int64() if f.endswith("long") else pa.string() for f in SEALED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in SEALED.split(", ")])


def seal(records: DataFrame) -> DataFrame:
    """Chains of records (chain: not null; ts, kind, subject, payload), in the order of time, subject, kind and payload."""
    rows = records.select("chain", F.col("ts").cast("long").alias("ts"), *(F.col(c).cast("string").alias(c) for c in ("kind", "subject", "payload")))
    return rows.repartition("chain").sortWithinPartitions("chain", "ts", "subject", "kind", "payload").mapInArrow(_seal, SEALED)


def checked(log: DataFrame) -> DataFrame:
    """log with fault: repeated (another record has its number), gap (none has the number before), unlinked (prev_hash is
    not the hash stored before), edited (its body does not give its hash) or null. The first that applies is given."""
    ends = log.groupBy("chain", "seq").agg(F.count("*").alias("copies"), F.min("hash").alias("stored"))
    before = ends.select("chain", (F.col("seq") + 1).alias("seq"), F.col("stored").alias("stored_before"))
    rows = log.join(ends.select("chain", "seq", "copies"), ["chain", "seq"]).join(before, ["chain", "seq"], "left")
    known = F.when(F.col("seq") == 0, F.lit(GENESIS)).otherwise(F.col("stored_before"))
    fault = F.when(F.col("copies") > 1, "repeated").when(known.isNull(), "gap").when(~F.col("prev_hash").eqNullSafe(known), "unlinked").when(~F.col("hash").eqNullSafe(record_hash()), "edited")
    return rows.withColumn("fault", fault).drop("copies", "stored_before")


def verify(log: DataFrame) -> DataFrame:
    """chain, records, sound, broken_at (number of the first record at fault) and fault. Records cut off the end are not seen."""
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("seq", "fault")))
    rows = checked(log).groupBy("chain").agg(F.count("*").alias("records"), first.alias("first"))
    return rows.select("chain", "records", F.col("first").isNull().alias("sound"), F.col("first.seq").alias("broken_at"), F.col("first.fault").alias("fault"))


RECORDS = "SELECT CAST(owner AS VARCHAR(20)) AS chain, unix_micros(CAST(ts AS TIMESTAMP)) AS ts, symbol AS kind, CAST(event_id AS VARCHAR(20)) AS subject, CAST(k AS VARCHAR(20)) AS payload FROM ev"


def log_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, a chain for each owner."""
    return seal(view(spark, sf_dir, RECORDS)).select("chain", "seq", "subject", "prev_hash", "hash")


def log_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds in event logs where some records were edited, some were edited and hashed anew, and some are gone."""
    log = kept(seal(view(spark, sf_dir, RECORDS)), "log")
    n = F.col("subject").cast("long")
    payload = F.when(n % 97 == 0, F.concat("payload", F.lit("!"))).when(n % 89 == 0, F.concat("payload", F.lit("?"))).otherwise(F.col("payload"))
    harmed = log.where(n % 101 != 0).withColumn("payload", payload)
    return verify(harmed.withColumn("hash", F.when(n % 89 == 0, record_hash()).otherwise(F.col("hash")))).withColumn("broken_at", F.coalesce("broken_at", F.lit(-1)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"log_seal": log_seal, "log_verify": log_verify}


def _sized(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _hash(prev: str, of: str = "") -> str:
    return "sha256(" + " || ".join(_sized(v) for v in (*(of + c for c in BODY[:-1]), prev)) + ")"


_CHAIN = f"""
WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS chain, epoch_us(ts) AS ts, event_type AS kind, CAST(event_id AS VARCHAR) AS subject, CAST(CAST(json_extract_string(props, '$.k') AS INT) AS VARCHAR) AS payload FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ts, encode(subject), kind, payload) - 1 AS seq FROM r),
log AS (
  SELECT chain, seq, ts, kind, subject, payload, '{GENESIS}' AS prev_hash, {_hash(f"'{GENESIS}'")} AS hash FROM n WHERE seq = 0
  UNION ALL
  SELECT n.chain, n.seq, n.ts, n.kind, n.subject, n.payload, l.hash, {_hash("l.hash", "n.")} FROM log l JOIN n ON n.chain = l.chain AND n.seq = l.seq + 1)"""
ORACLE_SQL = {
    "log_seal": _CHAIN + " SELECT chain, seq, subject, prev_hash, hash FROM log",
    "log_verify": _CHAIN
    + f""",
left_ AS (SELECT *, CAST(subject AS BIGINT) AS e FROM log WHERE CAST(subject AS BIGINT) % 101 <> 0),
harmed AS (SELECT * REPLACE (CASE WHEN e % 97 = 0 THEN payload || '!' WHEN e % 89 = 0 THEN payload || '?' ELSE payload END AS payload) FROM left_),
stored AS (SELECT *, {_hash("prev_hash")} AS own FROM harmed),
seen AS (SELECT *, CASE WHEN e % 89 = 0 THEN own ELSE hash END AS kept FROM stored),
linked AS (SELECT *, lag(kept) OVER w AS before, lag(seq) OVER w AS number FROM seen WINDOW w AS (PARTITION BY chain ORDER BY seq)),
judged AS (SELECT chain, seq, CASE WHEN seq > 0 AND (number IS NULL OR number <> seq - 1) THEN 'gap' WHEN prev_hash <> CASE WHEN seq = 0 THEN '{GENESIS}' ELSE before END THEN 'unlinked' WHEN own <> kept THEN 'edited' END AS fault FROM linked)
SELECT chain, count(*) AS records, count(fault) = 0 AS sound, coalesce(min(CASE WHEN fault IS NOT NULL THEN seq END), -1) AS broken_at, arg_min(fault, seq) FILTER (fault IS NOT NULL) AS fault FROM judged GROUP BY chain""",
}
