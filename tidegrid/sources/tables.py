"""Tables of a data folder, and SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The statement over the folder's tables. They are passed as arguments, so no view outlives the call."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", text)]
    for n in used:
        text = re.sub(rf"(?<![\w.]){n}(?![\w.(])", f"{{{n}}}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in used})
