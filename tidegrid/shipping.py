"""Gives the executors' Python workers this package, wherever the driver was started."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    with tempfile.NamedTemporaryFile(prefix=f"{ROOT.name}-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(f.name)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
