"""A lake of Parquet tables with a manifest that names every file.

Bars are partitioned by interval and symbol; a write replaces the partitions it has rows
for and no others. Then the files of these partitions are read back once for their bytes
(size and SHA-256) and once for their rows (count, first and last time), and their
manifest rows replace those of the same partitions: the manifest is itself partitioned
by the key it is replaced by, so an upsert is one dynamic overwrite and needs no lock on
the rest. A symbol is split over several files when it is large, so no task writes more
than its share; `rows_per_file` bounds a file, which is hashed in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.folds import view
from ..sources.shared import shared

KEYS = ("interval", "symbol")
NONE = "__none__"  # the partition of what has no interval or symbol


class Lake:
    """Tables below a root that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 2_000_000) -> None:
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file

    def write_bars(self, bars: DataFrame, dataset: str = "klines", time: str = "open_time") -> DataFrame:
        """Writes bars (interval, symbol, time and others) and returns their manifest rows. Symbols that are not in bars stay as they are."""
        path = f"{self.root}/{dataset}"
        rows = bars.repartitionByRange(*KEYS, time).sortWithinPartitions(*KEYS, time)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.rows_per_file).option("compression", "zstd").partitionBy(*KEYS).parquet(path)
        touched = bars.select(*KEYS).distinct()
        return self._record(dataset, path, touched, time)

    def write_reference(self, name: str, frame: DataFrame) -> DataFrame:
        """Writes a table as a whole and returns its manifest rows."""
        path = f"{self.root}/reference/{name}"
        frame.write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).option("compression", "zstd").parquet(path)
        return self._record(f"reference/{name}", path, None, None)

    def _record(self, dataset: str, path: str, touched: DataFrame | None, time: str | None) -> DataFrame:
        stamp = F.current_timestamp()
        where = F.concat(F.lit("/"), F.substring_index("path", f"/{dataset}/", -1))
        bytes_ = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        hashed = bytes_.select(F.col("_metadata.file_path").alias("file"), where.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))  # file is encoded as a URI, path is not
        span = [F.min(time).cast("timestamp").alias("first_ts"), F.max(time).cast("timestamp").alias("last_ts")] if time else [F.lit(None).cast("timestamp").alias(c) for c in ("first_ts", "last_ts")]
        keys = [k for k in KEYS if touched is not None]
        table = self._table(path).select("*", F.col("_metadata.file_path").alias("file"))
        if touched is not None:
            table = table.join(touched, list(KEYS), "left_semi")  # the join's keys prune partitions
        counted = table.groupBy("file", *keys).agg(F.count("*").alias("rows"), *span)
        found = counted.join(hashed, "file").select(
            "path", "rows", "bytes", "sha256", "first_ts", "last_ts", stamp.alias("ingested_at"), F.lit(dataset.replace("/", ".")).alias("dataset"), *(F.col(k) if k in keys else F.lit(NONE).alias(k) for k in KEYS)
        )
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", *KEYS).parquet(f"{self.root}/manifest")
        return self.manifest().where(F.col("dataset") == dataset.replace("/", "."))

    def _table(self, path: str) -> DataFrame:
        """The table at path, whose partition columns are texts whatever they look like (1d is no number)."""
        fields = self.spark.read.parquet(path).schema
        return self.spark.read.schema(StructType([StructField(f.name, StringType() if f.name in KEYS else f.dataType) for f in fields])).parquet(path)

    def manifest(self) -> DataFrame:
        """dataset, interval, symbol, path (below the dataset), rows, bytes, sha256, first_ts, last_ts, ingested_at: a row a file."""
        schema = "path string, rows long, bytes long, sha256 string, first_ts timestamp, last_ts timestamp, ingested_at timestamp, dataset string, interval string, symbol string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifest")

    def manifest_hash(self) -> str:
        """One SHA-256 over the manifest in order of dataset and path: the version of the data. It is taken in one stream, as such a hash must be."""

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = hashlib.sha256()
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("dataset", "path", "rows", "sha256")), strict=True):
                    total.update(("|".join(map(str, row)) + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()])], ["h"])

        return self.manifest().select("dataset", "path", "rows", "sha256").orderBy("dataset", "path").coalesce(1).mapInArrow(stream, "h string").first()["h"]

    def read_bars(self, dataset: str = "klines", interval: str | None = None, symbols: list[str] | None = None) -> DataFrame:
        """Bars of an interval and of symbols, from their partitions only."""
        found = self._table(f"{self.root}/{dataset}")
        if interval:
            found = found.where(F.col("interval") == interval)
        return found.where(F.col("symbol").isin(symbols)) if symbols else found

    def verify(self, dataset: str = "klines") -> DataFrame:
        """path and state of every file: same, changed, missing (in the manifest only) or stray (in the lake only)."""
        path = f"{self.root}/{dataset.replace('.', '/')}"
        bytes_ = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        now = bytes_.select(F.concat(F.lit("/"), F.substring_index("path", f"/{dataset.replace('.', '/')}/", -1)).alias("path"), F.sha2("content", 256).alias("now"))
        known = self.manifest().where(F.col("dataset") == dataset.replace("/", ".")).select("path", "sha256")
        state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "stray").when(F.col("now") == F.col("sha256"), "same").otherwise("changed")
        return known.join(now, "path", "full").select("path", state.alias("state"))


BARS = "SELECT '1d' AS interval, symbol, t AS open_time, open, high, low, close, volume, quote_volume, trades FROM bars_1d"


def sink_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written to a lake, half of the symbols twice: each symbol's rows and span by the manifest, whether the
    files' hashes hold, and whether what is read back has the manifest's rows."""
    lake, bars = Lake(spark, shared(spark, "lake")), view(spark, sf_dir, BARS)
    lake.write_bars(bars)
    lake.write_bars(bars.where("symbol < 'Brand#3'"))
    told = lake.manifest().join(lake.verify(), "path").groupBy("symbol").agg(F.sum("rows").alias("rows"), F.min("first_ts").alias("a"), F.max("last_ts").alias("z"), F.min(F.col("state") == "same").alias("same"))
    back = lake.read_bars(interval="1d").groupBy("symbol").agg(F.count("*").alias("read"), F.countDistinct("open_time").alias("days"))
    return told.join(back, "symbol").select("symbol", "rows", F.to_date("a").alias("first_day"), F.to_date("z").alias("last_day"), "same", ((F.col("read") == F.col("rows")) & (F.col("days") == F.col("rows"))).alias("whole"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sink_klines": sink_klines}
_DAYS = "SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey"
ORACLE_SQL = {"sink_klines": f"SELECT symbol, count(DISTINCT day) AS rows, min(day) AS first_day, max(day) AS last_day, true AS same, true AS whole FROM ({_DAYS}) GROUP BY symbol"}
