"""Where the operators keep what must outlive an executor."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then removes a query's shuffle files when it ends, instead of when the driver collects its plan
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: list[tuple[SparkSession, str]] = []
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and all is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = held if held else "file://" + tempfile.mkdtemp(prefix="tidegrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; removed when the innermost scratch() or else the driver ends."""
    path = f"{shared_dir(spark)}/tidegrid-{name}-{uuid.uuid4().hex}"
    (_SCRATCH[-1] if _SCRATCH else _OWN).append((spark, path))
    return path


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written within go at its end; those written by the function it gives outlive it."""
    held: list[tuple[SparkSession, str]] = []
    outer = _SCRATCH[-1] if _SCRATCH else _OWN

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        outer.append(held.pop())
        return out

    _SCRATCH.append(held)
    try:
        yield keep
    finally:
        _SCRATCH.remove(held)
        for spark, path in held:
            _delete(spark, path)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder. The shuffle files of its plan go with the query.

    rows: so many in one Arrow batch, for rows that are long."""
    spark = df.sparkSession
    path, wanted = fresh_dir(spark, name), {CLEANUP: "true"} | ({ROWS: str(rows)} if rows else {})
    before = {key: spark.conf.get(key, "10000" if key == ROWS else "false") for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def keyed(docs: DataFrame, key: str = "key", more: str = "more", *others: str) -> DataFrame:
    """docs with two columns (96 bits) that name doc_id, text and others."""
    values = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *others]
    return docs.withColumns({key: F.xxhash64(*values), more: F.hash(*reversed(values))})


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop() -> None:
    for spark, path in _OWN:
        with contextlib.suppress(Exception):  # the session is gone; so is its need of the files
            _delete(spark, path)
