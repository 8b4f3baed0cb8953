"""Vendor files as DataFrames.

Every reader takes a path that Spark reads (a file, a folder or a glob) and stays in
the JVM: text is split and cast with `try_cast`, so a malformed line is dropped or a
malformed cell is null and no single line stops a scan of many files. Only zipped
members pass through Python, a file at a time. Where rows repeat, the last one wins,
in the order of file names and then of lines.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"

# Column names of the vendors' files.
KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
FUNDING = ("calc_time", "funding_interval_hours", "last_funding_rate")
OPEN_INTEREST = ("create_time", "symbol", "sum_open_interest", "sum_open_interest_value")
EOD = "array<struct<date string, open double, high double, low double, close double, volume double, divCash double, splitFactor double, adjOpen double, adjHigh double, adjLow double, adjClose double>>"


def number(column: Column | str, kind: str = "double") -> Column:
    return F.trim(column if isinstance(column, Column) else F.col(column)).try_cast(kind)


def epoch(column: Column | str) -> Column:
    """A timestamp from milliseconds or, from 1e14 on, microseconds."""
    value = number(column, "bigint")
    return F.timestamp_micros(F.when(value >= 100_000_000_000_000, value).otherwise(value * 1000))


def stamp(column: str) -> Column:
    """A timestamp from an epoch or from text."""
    return F.coalesce(epoch(column), F.try_to_timestamp(F.trim(column)))


def keep_last(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of each key: the last, by file and then by place in it (`_at`, which is dropped)."""
    rest = [c for c in rows.columns if c not in keys and c != "_at"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_row"))
    return last.select(*(c if c in keys else F.col("_row")[c].alias(c) for c in rows.columns if c != "_at"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value, _at: lines of text files, plain or compressed by a codec that Spark knows."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r$", "").alias("value"), at.alias("_at"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("member", pa.string()), ("value", pa.string()), ("line", pa.int64())])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as packed:
                for member in packed.namelist():
                    held: list[str] = []
                    first = 0
                    with packed.open(member) as stream:
                        for raw in stream:
                            held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                            if len(held) == 50_000:
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([member] * len(held)), pa.array(held), pa.array(range(first, first + len(held)))], schema=schema)
                                first, held = first + len(held), []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([member] * len(held)), pa.array(held), pa.array(range(first, first + len(held)))], schema=schema)


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, member, value, _at: lines of all members of zip files; members are streamed, never whole in Python."""
    packed = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = packed.mapInArrow(_members, "file string, member string, value string, line bigint")
    return rows.select("file", "member", "value", F.struct("file", "member", "line").alias("_at"))


def any_lines(spark: SparkSession, path: str) -> DataFrame:
    return zipped_lines(spark, path).drop("member") if path.endswith(".zip") else lines(spark, path)


def verified(spark: SparkSession, path: str, suffix: str = ".CHECKSUM") -> DataFrame:
    """file, sha256, expected, ok: files against the SHA-256 in their sidecar; ok is null where there is none."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("content"))
    marks = files.where(F.col("file").endswith(suffix)).select(F.regexp_replace("file", f"\\Q{suffix}\\E$", "").alias("file"), F.lower(F.split(F.trim(F.col("content").cast("string")), "\\s+")[0]).alias("expected"))
    plain = files.where(~F.col("file").endswith(suffix)).select("file", "sha256")
    return plain.join(marks, "file", "left").withColumn("ok", F.col("sha256") == F.col("expected"))


def delimited(rows: DataFrame, names: tuple[str, ...], by: str = ",") -> DataFrame:
    """Columns by position; missing ones are null."""
    cells = F.split("value", f"\\Q{by}\\E")
    return rows.select("file", "_at", *(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)))


def _symbol() -> Column:
    return F.regexp_extract("file", r"^([^-.]+)", 1)


def klines(spark: SparkSession, path: str) -> DataFrame:
    """symbol, open_time, prices and volumes of 12-column bar files, with or without a header."""
    rows = delimited(any_lines(spark, path), KLINE).where(number("open_time", "bigint").isNotNull())
    values = [number(c).alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote")]
    return keep_last(rows.select(_symbol().alias("symbol"), epoch("open_time").alias("open_time"), *values, number("trades", "bigint").alias("trades"), "_at"), "symbol", "open_time")


def funding(spark: SparkSession, path: str) -> DataFrame:
    rows = delimited(any_lines(spark, path), FUNDING).where(number("calc_time", "bigint").isNotNull())
    return keep_last(rows.select(_symbol().alias("symbol"), epoch("calc_time").alias("t"), number("funding_interval_hours").alias("hours"), number("last_funding_rate").alias("rate"), "_at"), "symbol", "t")


def daily_funding(settlements: DataFrame) -> DataFrame:
    """Rates of the settlements of each UTC day, summed."""
    return settlements.groupBy("symbol", F.to_date("t").alias("day")).agg(F.sum("rate").alias("rate"), F.count("rate").alias("settlements"))


def open_interest(spark: SparkSession, path: str) -> DataFrame:
    """create_time ships as text or as an epoch."""
    rows = delimited(any_lines(spark, path), OPEN_INTEREST).where(stamp("create_time").isNotNull())
    return keep_last(rows.select(F.trim("symbol").alias("symbol"), stamp("create_time").alias("t"), number("sum_open_interest").alias("open_interest"), number("sum_open_interest_value").alias("value"), "_at"), "symbol", "t")


def eod_bars(spark: SparkSession, path: str, adjusted: bool = True) -> DataFrame:
    """Daily bars from JSON rows, a symbol a file. Adjusted prices, the raw ones where an adjustment is missing;
    volume is stated in the frame's price space, quote_volume is what changed hands."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("symbol"), F.posexplode(F.from_json("value", EOD)).alias("_at", "x"))
    x = F.col("x")
    price = {n: F.coalesce(x["adj" + n.capitalize()], x[n]) if adjusted else x[n] for n in ("open", "high", "low", "close")}
    ratio = F.when((price["close"] > 0) & (x["close"] > 0), x["close"] / price["close"]).otherwise(1.0)
    rows = files.select(
        "symbol", F.to_date(F.substring(x["date"], 1, 10)).alias("day"), *(c.alias(n) for n, c in price.items()), (x["volume"] * ratio).alias("volume"), (x["volume"] * x["close"]).alias("quote_volume"),
        x["close"].alias("close_unadjusted"), x["divCash"].alias("dividend"), x["splitFactor"].alias("split_factor"), "_at",
    )
    return keep_last(rows, "symbol", "day")


def ohlcv_csv(spark: SparkSession, path: str) -> DataFrame:
    """symbol (a file's name), day, open, high, low, close, volume of CSV files whose first column is a date.

    Columns are found by their headings, whatever their case and order; without a close, the adjusted one serves. The
    last row of a day stays; rows without a close go. A file that lacks a column is an error."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("symbol"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    cut = lambda line: F.transform(F.split(line, ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    files = text.select("symbol", F.transform(cut(F.col("lines")[0]), lambda c: F.lower(c)).alias("head"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("_at", "line"))
    place = {n: F.array_position("head", n) for n in ("open", "high", "low", "close", "volume")}
    place["close"] = F.when(place["close"] > 0, place["close"]).otherwise(F.array_position("head", "adj close"))
    missing = F.concat_ws(", ", *(F.when(p == 0, F.lit(n)) for n, p in place.items()))
    row = cut(F.col("line"))
    cells = files.where(F.trim("line") != "").withColumn("row", F.when(missing == "", row).otherwise(F.raise_error(F.concat(F.lit("columns missing in "), "symbol", F.lit(": "), missing))))
    day = F.to_date(F.substring(F.get("row", F.lit(0)), 1, 10).try_cast("date"))
    out = cells.select("symbol", day.alias("day"), *(F.get("row", (p - 1).cast("int")).try_cast("double").alias(n) for n, p in place.items()), "_at").where("day is not null")
    return keep_last(out, "symbol", "day").where("close is not null and not isnan(close)")


def rate_series(spark: SparkSession, path: str) -> DataFrame:
    """series, day, rate: `observation_date,SERIES` files in percent; a blank or `.` is null."""
    rows = delimited(any_lines(spark, path), ("day", "rate")).withColumn("day", F.to_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd")))).where("day is not null")
    return keep_last(rows.select(F.regexp_extract("file", r"^([^.]+)", 1).alias("series"), "day", (number("rate") / 100).alias("rate"), "_at"), "series", "day")


def daily_arrays(spark: SparkSession, path: str) -> DataFrame:
    """day, open, high, low, close from a JSON array of [t_ms, o, h, l, c]; the first row of a day stays."""
    x = F.col("x")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<double>>")).alias("at", "x"))
    rows = rows.select(F.to_date(F.timestamp_millis(x[0].cast("bigint"))).alias("day"), *(x[i].alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)), (-F.col("at")).alias("_at"))
    return keep_last(rows, "day")


def daily_index(spark: SparkSession, path: str) -> DataFrame:
    """day, value, class from API JSON whose data rows hold text cells and epoch seconds."""
    x = F.col("x")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.data"), "array<struct<timestamp string, value string, value_classification string>>")).alias("_at", "x"))
    return keep_last(rows.select(F.to_date(F.timestamp_seconds(number(x["timestamp"], "bigint"))).alias("day"), number(x["value"]).alias("value"), x["value_classification"].alias("class"), "_at"), "day")


def fails_to_deliver(spark: SparkSession, path: str) -> DataFrame:
    """settlement_date, cusip, symbol, fails, price, event_time. A description may hold the delimiter: only fields before it are read by position."""
    rows = delimited(any_lines(spark, path), ("day", "cusip", "symbol", "fails", "description", "price"), "|").where(F.col("day").rlike(r"^\d{8}$"))
    day = F.to_date("day", "yyyyMMdd")
    return rows.select(day.alias("settlement_date"), F.trim("cusip").alias("cusip"), F.trim("symbol").alias("symbol"), number("fails").alias("fails"), number("price").alias("price"), F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 16 hours"), ZONE).alias("event_time")).where("fails is not null")


def short_volume(spark: SparkSession, path: str) -> DataFrame:
    """Daily short volume, known to the public at 18:00 New York of its day."""
    rows = delimited(any_lines(spark, path), ("day", "symbol", "short", "exempt", "total", "market"), "|").where(F.col("day").rlike(r"^\d{8}$"))
    day = F.to_date("day", "yyyyMMdd")
    at = lambda hour: F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"interval {hour} hours"), ZONE)
    return rows.select(day.alias("day"), F.trim("symbol").alias("symbol"), *(number(c).alias(c) for c in ("short", "exempt", "total")), F.trim("market").alias("market"), at(16).alias("event_time"), at(18).alias("published_at"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded JSON lines; lines that are no JSON and truncated tails of compressed files are skipped."""
    text = spark.read.option("ignoreCorruptFiles", True).text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).where("x is not null").select("x.*")


def liquidations(spark: SparkSession, path: str, venue: str, contract_value: DataFrame | None = None) -> DataFrame:
    """t, symbol, dir, usd, venue. With contract_value (symbol, ctval: one row a symbol), symbols without one are dropped."""
    rows = json_lines(spark, path, "symbol string, qty string, price string, side string, event_time_ms bigint").where("event_time_ms is not null")
    usd = number("qty") * number("price")
    if contract_value is not None:
        rows, usd = rows.join(contract_value.select("symbol", "ctval"), "symbol"), usd * F.col("ctval")
    side = F.when(F.lower("side") == "sell", "sell").otherwise("buy")
    return rows.select(F.timestamp_millis("event_time_ms").alias("t"), "symbol", side.alias("dir"), usd.alias("usd"), F.lit(venue).alias("venue")).where("usd is not null")


def insider_trades(submissions: DataFrame, trades: DataFrame, owners: DataFrame, notes: DataFrame) -> DataFrame:
    """One row a transaction and owner: trades, the filing they are in, each reporting owner, the filing's footnotes.

    submissions: accession, filing_date (DD-MON-YYYY), document_type; trades: accession, trans_date, shares, price;
    owners: accession, owner_cik, owner_relationship; notes: accession, footnote_id, footnote. Further columns stay."""
    day = lambda c: F.to_date(F.try_to_timestamp(F.initcap(c), F.lit("dd-MMM-yyyy")))
    told = notes.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("footnote_id", "footnote"))), lambda x: x["footnote"]), " | ").alias("footnotes"))
    parts = F.split("owner_relationship", ",")
    filed = submissions.withColumn("filing_date", day("filing_date")).withColumn("is_amendment", F.col("document_type").endswith("/A"))
    dealt = trades.withColumn("trans_date", day("trans_date")).withColumn("shares", number("shares")).withColumn("price", number("price")).withColumn("value_usd", F.col("shares") * F.col("price"))
    held = owners.withColumn("is_officer", F.array_contains(parts, "Officer")).withColumn("is_director", F.array_contains(parts, "Director"))
    rows = dealt.join(filed, "accession").join(held, "accession").join(told, "accession", "left")
    return rows.withColumn("footnotes", F.coalesce("footnotes", F.lit(""))).withColumn("event_time", F.to_utc_timestamp(F.col("trans_date").cast("timestamp") + F.expr("interval 16 hours"), ZONE))
