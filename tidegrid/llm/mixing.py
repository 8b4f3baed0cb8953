"""Mixing sources to target weights by capped water-filling.

Every source asks for the budget (`share` of all words) in proportion to its weight;
a source whose level passes `epochs` times its size is clamped there and the excess
is shared by weight among the rest. With the sources ordered by cap / weight the
level is one prefix sum, so no loop is needed. A target is met by whole repetitions
of every document plus a seeded partial one: documents in the order of
md5(seed:doc_id) are taken until the rest is filled, the last of them in part. The
prefix sums run over hash buckets first, and only the one bucket in which a source's
rest ends is ordered row by row, so a source with a third of all rows stays spread.

Defined results: null text has size 0; a null source is a source of its own, last in
order; sources without words get target 0; repeated rows count each; ties in a draw go by doc_id and size; an empty table
gives no rows. Columns other than doc_id, source and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._session import free_name, keyed, written

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2, "mix-1"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.pieces(batches):
        data, offsets = K.text_buffers(batch.column("text"))
        _, _, firsts = K.find_words(data, offsets, K.SPACES)
        names = ["doc_id", "source", "key", "more"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(firsts).astype(np.int64))], [*names, "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key and more (which name doc_id, text and source), size (words) of each document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return keyed(source, "key", "more", "source").mapInArrow(K.lean(_sizes), "doc_id long, source string, key long, more int, size long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source. The windows here run over sources, not documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    slot = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", slot).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    chosen = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(every)
    return per.select("source", "source_size", F.coalesce(F.least("cap", chosen * F.col("w")), "cap").alias("target"))


def mix_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, key, more, size, source_size, target, taken: how many words of each document the mix takes."""
    sized = written(sized, "sizes")
    goal = targets(sized, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    goal = goal.withColumnRenamed("source", "g_source")
    keyed = sized.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("bucket", F.substring("draw", 1, 3))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    cumulated = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("ahead", cumulated).join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "held", "ahead", "source_size", "target", "whole", "rest")
    placed = keyed.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    inside = F.col("ahead") + F.col("held") <= F.col("rest")
    splits = ~inside & (F.col("ahead") < F.col("rest"))
    own = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "key", "more", "size", "source_size", "target"]
    simple = placed.where(~splits).select(*columns, (F.col("whole") * F.col("size") + F.when(inside, F.col("size")).otherwise(0)).alias("taken"))
    so_far = F.col("ahead") + F.coalesce(F.sum("size").over(own), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - so_far))
    return simple.unionByName(placed.where(splits).withColumn("part", part).select(*columns, (F.col("whole") * F.col("size") + F.col("part")).alias("taken")))


def _prefixes(part: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n in zip(batch.column("text").to_pylist(), batch.column(part).to_pylist(), strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                _, ends, _ = K.find_words(data, np.array([0, len(data)]), K.SPACES)
                out.append(raw[: ends[n - 1]].decode())
            names = [c for c in batch.schema.names if c != part]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return run


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of docs: whole documents as often as they are taken, and the
    first words of the one document a source takes in part. Documents of no words are kept once. Rows
    that repeat one doc_id, text and source share a plan."""
    key, more, size, taken, copies, part, copy = (free_name(docs, c) for c in ("key", "more", "size", "taken", "copies", "part", "copy"))
    plan = mix_plan(sizes(docs), **options).groupBy(F.col("key").alias(key), F.col("more").alias(more)).agg(F.max("size").alias(size), F.max("taken").alias(taken))
    named = keyed(docs.withColumns({taken: F.col("source").cast("string")}), key, more, taken).drop(taken)
    planned = named.join(plan, [key, more])
    some = F.col(size) > 0
    planned = planned.withColumn(copies, F.when(some, F.floor(F.col(taken) / F.greatest(F.col(size), F.lit(1)))).otherwise(1).cast("int"))
    planned = planned.withColumn(part, F.when(some, F.col(taken) % F.col(size)).otherwise(0).cast("int"))
    whole = planned.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
    partial = planned.where(F.col(part) > 0).select(*docs.columns, part).mapInArrow(K.lean(_prefixes(part)), docs.schema)
    return whole.unionByName(partial)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    return mix_plan(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("key", "more")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST(r % 3 AS INT) + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT level FROM l WHERE level <= cap / w ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM c) * w), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target - p.whole * p.source_size + 0.5) AS BIGINT) AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM q
"""
