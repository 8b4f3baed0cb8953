"""Places of rows within their groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import written


def indexed(df: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """df with place (0, 1, ... in the order given) and members (rows of the group), both long.

    One range shuffle spreads a large group over many partitions; only one row for each group and partition is
    counted on. The rows are written before, so a repeated task gives the same places. group: not null; order must
    leave ties only between equal rows. The columns at, part, base and least_ are used inside."""
    by = [F.col(group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    blocks = rows.groupBy(group, "part").agg(F.min("at").alias("least_"), F.count("*").alias("rows_"))
    before = Window.partitionBy(group).orderBy("part")
    blocks = blocks.select(group, "part", "least_", (F.sum("rows_").over(before) - F.col("rows_")).alias("base"), F.sum("rows_").over(Window.partitionBy(group)).alias("members"))
    return rows.join(blocks, [group, "part"]).withColumn("place", F.col("at") - F.col("least_") + F.col("base")).drop("at", "part", "least_", "base")
