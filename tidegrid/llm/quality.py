"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A
document is compressed in blocks of `block` bytes with each; the difference of the
two sizes over its length is large where the text resembles the good examples. A
logistic curve fitted on labelled documents that no dictionary saw turns it into a
probability.

The fit takes a bounded sample: at most `per_class` labelled documents of each class,
in the order of md5(doc_id), of at most `longest` characters each; a quarter of them
only calibrate. Each of those weighs as many labels as it was drawn for (labels of its
class over sampled ones), so the curve sees the classes in the ratio of all labels,
whatever their number. Scoring covers every document and its whole text. Only the text is
an input of a score.

Defined results: null and empty texts get the score of a difference of 0; labels
that are null, or contradict each other for one doc_id, are not learned from; of a doc_id
with several texts the one of least MD5 may be; where
one class has no example every score is the smoothed share of good labels (0.5
without labels). Columns with clashing names play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS, LONGEST, DICTIONARY, BLOCK, LEVEL, THRESHOLD, FOLD = 3000, 60_000, 112_640, 256, 3, 0.7, 2


class Model:
    """Two dictionaries and the calibration of their difference."""

    def __init__(self, good: bytes, bad: bytes, slope: float, shift: float, block: int = BLOCK, level: int = LEVEL) -> None:
        self.good, self.bad, self.slope, self.shift, self.block, self.level = good, bad, slope, shift, block, level
        self._tools = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def difference(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / length."""
        if not self.good or not text:
            return 0.0
        if self._tools is None:
            self._tools = [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        raw = text.encode()
        view, step = memoryview(raw), self.block
        good, bad = (sum(len(c.compress(view[i : i + step])) for i in range(0, len(raw), step)) for c in self._tools)
        return (bad - good) / (len(raw) + 16)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.shift, -30, 30))))


def _dictionary(texts: list[str], block: int, size: int) -> bytes:
    samples = [raw[i : i + block] for raw in (t.encode() for t in texts) for i in range(0, len(raw), block)]
    while size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too little text for a dictionary of this size
            size //= 2
    return zstandard.ZstdCompressionDict(b"\n".join(samples)[:DICTIONARY] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over weighted examples, by damped Newton steps with a weak ridge."""
    scale = max(float(np.std(x)), 1e-6)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, fold: int | None = FOLD, per_class: int = PER_CLASS, longest: int = LONGEST, block: int = BLOCK, dictionary: int = DICTIONARY) -> Model:
    """Learns from labels (doc_id, quality) of docs whose held_out() is false (all where fold is None)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if fold is not None:
        known = known.where(~held_out(F.col("doc_id"), fold))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    order = F.md5(F.col("doc_id").cast("string"))
    picked = [(r.doc_id, q) for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class).collect()]
    if not picked:
        return Model(b"", b"", 0.0, 0.0)
    drawn = Counter(q for _, q in picked)
    stands = {r.quality: r["count"] / drawn[r.quality] for r in known.groupBy("quality").count().collect()}  # labels a sampled one stands for
    ids = spark.createDataFrame(picked, "sample_id long, quality int")  # at most 2 * per_class rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, longest))
    met = own.join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"))
    rows = met.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")).select("text", "quality", order.alias("o")).collect()  # a repeated doc_id: one of its texts, whatever the order of rows
    rows = sorted(rows, key=lambda r: (r.o, r.text))
    by = {q: [r.text for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, by.values())) < 2:
        good, bad = (len(by[q]) * stands.get(q, 1.0) for q in (1, 0))
        return Model(b"", b"", 0.0, float(np.log((good + 1) / (bad + 1))))
    seen = {q: t[: max(1, len(t) * 3 // 4)] for q, t in by.items()}
    model = Model(_dictionary(seen[1], block, dictionary), _dictionary(seen[0], block, dictionary), 1.0, 0.0, block)
    fresh = [(model.difference(t), q) for q in (0, 1) for t in by[q][len(seen[q]) :]]
    x, y = (np.array(v, float) for v in zip(*fresh, strict=True))
    weight = np.where(y == 1, stands[1], stands[0])
    model.slope, model.shift = calibrate(x, y, weight / weight.mean())
    return model


def held_out(doc_id: Column, fold: int = FOLD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == fold, F.lit(False))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of probabilities of label 1."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        return texts.map(share.value.score)

    return docs.withColumn(column, of(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
