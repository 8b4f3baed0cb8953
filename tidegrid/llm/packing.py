"""Vector best-fit packing of documents' tokens into sequences.

A sequence has three capacities: tokens, pieces of documents, and attention cost (the
sum of squared lengths, as attention does not cross documents). A piece takes
(length, 1, length**2) of them. Pieces are taken from the longest to the shortest; a
piece goes to the open sequence that is best by the residual's weighted norm (the one
that would be left fullest) or by the weighted dot product of piece and residual,
among those that hold it under every capacity; a new one is opened if none does.

A piece's vector follows from its length alone, and so does what best fit does with
it. So the packing is planned for the histogram of lengths (at most `capacity` numbers,
however many documents there are): an open state is a residual and how many sequences
have it, and one step moves as many of them as there are pieces. Each length splits
one state and opens one partly filled sequence at most, so the plan has at most a few
entries a length; it is sent to the tasks.

1. `pieces`: documents are encoded and cut where they lie, without a shuffle; a table of
   pieces (no ids) is written, each with its task and its place among the pieces of its
   length there.
2. The counts by task and length, summed over tasks in order, give each piece its rank
   among all pieces of its length.
3. The plan says which sequence and offset the piece of a rank gets.

Defined results: null text is empty, and an empty text is its end id alone; rows that
repeat a doc_id are packed as documents of their own; a null doc_id is kept; an empty
table gives no rows; other columns play no part. A document longer than the capacity
is cut into whole sequences from its end, so its first piece may be shorter. Limits
that no piece of full length meets raise an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._session import written
from .token_files import END, tokenizer_path

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth int"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds. Without limits on pieces and attention every sequence of `tokens` is within them."""

    tokens: int = CAPACITY
    pieces: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2], np.int64)


@dataclass(eq=False)
class State:
    """count sequences from number first on, with the same residual; used: tokens placed in each."""

    residual: np.ndarray
    first: int
    count: int
    used: int


def plan(histogram: dict[int, int], limits: Limits) -> tuple[np.ndarray, int]:
    """Best fit of all pieces of a histogram (length: pieces): entries and the number of sequences.

    An entry (length, base, each, first, offset): pieces of that length from rank base on go to the sequences from
    first on, `each` to a sequence, the first at offset; it ends where the next of the same length begins."""
    whole, weights = limits.vector(), np.array(limits.weights, float)
    opened: list[State] = []
    entries, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        item, left, rank = np.array([length, 1, length * length], np.int64), histogram[length], 0
        while left:
            fits = [s for s in opened if (s.residual >= item).all()]
            one = bool(fits) and limits.rule == "dot"  # a piece makes its sequence worse for the next one; it makes the fullest one fuller
            if fits:
                if limits.rule == "dot":
                    best = max(fits, key=lambda s: (float((weights * (s.residual / whole) * (item / whole)).sum()), -s.first))
                else:
                    best = min(fits, key=lambda s: (float((weights * ((s.residual - item) / whole) ** 2).sum()), s.first))
                opened.remove(best)
            else:
                room = int((whole // item).min())
                if not room:
                    raise ValueError(f"a piece of {length} tokens exceeds the limits of a sequence")
                best = State(whole, sequences, math.ceil(left / room), 0)
                sequences += best.count
            each = 1 if one else min(left, int((best.residual // item).min()))
            many = min(best.count, left // each)
            entries.append((length, rank, each, best.first, best.used))
            rank += many * each
            left -= many * each
            opened.append(State(best.residual - each * item, best.first, many, best.used + each * length))
            if many < best.count:
                opened.append(State(best.residual, best.first + many, best.count - many, best.used))
        opened = [s for s in opened if s.residual.min() > 0]
    return np.array(entries, np.int64).reshape(-1, 5), sequences


def _nth(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The place of each length among equal ones; seen: how many there were before, brought up to date."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ranked)) - np.repeat(new, np.diff(np.append(new, len(ranked)))) + seen[ranked]
    np.add.at(seen, lengths, 1)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, *, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Pieces of all documents, with the task that made them and the place among those of the same length there."""
    path = vocabulary or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import Encoder

        encoder, task, seen = Encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in K.pieces(batches):
            ids, firsts = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            n = len(firsts) - 1
            wide = np.full(len(ids) + n, end, "<u4")
            wide[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(firsts))] = ids
            firsts = firsts + np.arange(n + 1)
            sizes = np.diff(firsts)
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(n), cuts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            stop = sizes[row] - (cuts[row] - 1 - nth) * capacity
            start = np.maximum(stop - capacity, 0)
            sums = [zlib.crc32(wide[a:b]) for a, b in zip((firsts[row] + start).tolist(), (firsts[row] + stop).tolist(), strict=True)]
            lengths = stop - start
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(_nth(lengths, seen), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), PIECES)


def _place(entries: np.ndarray):
    """Sequence and offset of pieces by length and rank."""
    order = np.lexsort((entries[:, 1], entries[:, 0]))
    lengths, bases, each, first, offset = entries[order].T
    begin = np.searchsorted(lengths, np.arange(lengths.max() + 2)) if len(lengths) else np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for size in np.unique(length):
                which = np.flatnonzero(length == size)
                at[which] = begin[size] + np.searchsorted(bases[begin[size] : begin[size + 1]], rank[which], "right") - 1
            inner = rank - bases[at]
            columns = [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length), batch.column("ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[at] + inner // each[at]), pa.array(offset[at] + inner % each[at] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, limits: Limits | None = None, *, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    limits = limits or Limits()
    found = written(pieces(docs, limits.tokens, vocabulary=vocabulary, end=end), "pieces")
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    entries, _ = plan(histogram, limits)
    bases = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = found.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(_place(entries), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
