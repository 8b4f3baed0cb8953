"""Exact repeats of fixed-length windows across documents, on content-defined anchors.

Every window of `length` symbols picks one anchor inside it by content alone
(`_kernel.anchors`), so equal windows pick equal anchors at equal places; a run of
windows that share an anchor is a path, described by the hash of all its symbols.

1. `paths`: every document's paths, as (anchor, path, doc_id, ordinal).
2. `repeated`: anchors of one document only are dropped. A path that a smaller
   document has too goes as a whole. Of each other path only the occurrence in its
   least document is left; where its anchor has several paths (it branches), that
   one occurrence is marked to be opened.
3. `windows`: the marked paths are opened into single windows, named by 96 bits; a
   window goes where a smaller document has it too.

Both 2 and 3 take one shuffle and one sort, in turns: each turn has the anchors or windows of
one residue of their hashes, whole, so only its share of the rows is on disk at a time.
Before it every batch of documents is
combined: an occurrence that a smaller document of the batch repeats is decided
there, and travels under a key of its own (its ordinal made negative), so a passage
that a third of all documents share meets as one row a batch. The marks of a
document are as long as the document at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K

#: Bytes of text that are hashed at a time, so that the arrays stay in the cache; what a batch combines is not cut by it
BLOCK = 1 << 17
#: Symbols of a batch of documents: their hashes, and each document's first (rows + 1 values)
Symbols = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def source(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, text and, if keyed, key: it names the row's doc_id and text."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc.alias("doc_id"), text.alias("text"), *([F.xxhash64(doc, text).alias("key")] if keyed else []))


def mixed(docs: DataFrame) -> bool:
    """Whether a doc_id has rows with different texts; a row's marks then go by (doc_id, text), else by doc_id alone."""
    rows = source(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    return not rows.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty()


def _key(keyed: bool) -> str:
    return "key" if keyed else "doc_id"


def _with_key(fields: list[pa.Array], names: list[str], batch: pa.RecordBatch, row: np.ndarray, keyed: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*fields, batch.column("key").take(pa.array(row))] if keyed else fields, [*names, "key"] if keyed else names)


def _ordinals(rows: np.ndarray) -> np.ndarray:
    """0, 1, ... within each row of paths (rows ascending)."""
    new = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of about `BLOCK` bytes of text, and the rows before each."""
    before = 0
    for block in K.pieces([batch], BLOCK):
        yield block, before
        before += block.num_rows


def _joined(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The length of each row's list (null: 0), and all values."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _decided(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True where a smaller document of the batch has the same key."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(k), bool)
    out[order] = d > least
    return out


def _rows(batch: pa.RecordBatch, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id of each path's row, and whether it is known."""
    column = batch.column("doc_id").cast(pa.int64())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy()[row], valid[row]


def _own_keys(keys: np.ndarray, decided: np.ndarray, docs: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ordinals for the shuffle: decided rows spread by themselves, with -1 - ordinal."""
    alone = K.mix(docs.view(np.uint64) * np.uint64(K.BASE) + ordinals.astype(np.uint64), 31)
    return np.where(decided, alone, keys), np.where(decided, -1 - ordinals, ordinals).astype(np.int32)


def paths(docs: DataFrame, symbols: Symbols, gram: int, length: int, limit: int = K.CHUNK, keyed: bool = False, turn: int = 0, turns: int = 1) -> DataFrame:
    """The paths whose anchor has the residue `turn`; ordinals count all paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            found = []
            for block, before in _blocks(batch):
                hashes, firsts = symbols(block)
                anchor, at, lo, hi, row = K.anchors(hashes, firsts, gram, length)
                doc, known = _rows(block, row)
                ordinal = _ordinals(row)
                some = known & (anchor % np.uint64(turns) == turn)
                anchor, at, lo, hi, doc, ordinal, row = (x[some] for x in (anchor, at, lo, hi, doc, ordinal, row))
                whole = K.hash_spans(hashes, lo, hi + length) + K.mix((at - lo).astype(np.uint64), 5)
                found.append((anchor, whole, doc, ordinal, row + before))
            anchor, whole, doc, ordinal, row = _joined(found)
            key, ordinal = _own_keys(anchor, _decided(anchor ^ K.mix(whole, 6), doc), doc, ordinal)
            yield _with_key([K.as_long(key), K.as_long(whole), pa.array(doc), pa.array(ordinal)], ["anchor", "path", "doc_id", "ordinal"], batch, row, keyed)

    return source(docs, keyed).mapInArrow(run, "anchor long, path long, doc_id long, ordinal int" + ", key long" * keyed)


def repeated(found: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id (or key), marks: 2 * ordinal of every path that goes, 2 * ordinal + 1 of every path to be opened."""
    alike, near = Window.partitionBy("anchor", "path"), Window.partitionBy("anchor")
    seen = found.repartition("anchor").withColumn("least", F.min("doc_id").over(alike))
    for name, value in (("lo", F.min("doc_id")), ("hi", F.max("doc_id")), ("p", F.min("path")), ("q", F.max("path"))):
        seen = seen.withColumn(name, value.over(near))
    o = F.col("ordinal")
    mark = F.when(o < 0, (-1 - o) * 2).when(F.col("doc_id") > F.col("least"), o * 2).when((F.col("p") != F.col("q")) & (F.col("lo") < F.col("hi")), o * 2 + 1)
    return seen.select(_key(keyed), mark.alias("mark")).where("mark is not null").groupBy(_key(keyed)).agg(F.collect_list("mark").alias("marks"))


def _marked(batch: pa.RecordBatch, symbols: Symbols, gram: int, length: int) -> tuple:
    """Symbols of a batch, its paths, and each path's mark (-1: none, 0: whole, 1: branching)."""
    hashes, firsts = symbols(batch)
    _, _, lo, hi, row = K.anchors(hashes, firsts, gram, length)
    mark = np.full(len(lo), -1, np.int8)
    begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
    sizes, values = _lists(batch.column("marks"))
    at = np.repeat(begin[:-1], sizes) + (values >> 1)
    mark[at] = values & 1
    return hashes, firsts, lo, hi, row, mark


def windows(docs: DataFrame, marks: DataFrame, symbols: Symbols, gram: int, length: int, limit: int = K.CHUNK, keyed: bool = False, turn: int = 0, turns: int = 1) -> DataFrame:
    """doc_id (or key), starts: starts (in the document) of the windows of branching paths that a smaller document has too, of those whose hash has the residue `turn`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            found = []
            for block, before in _blocks(batch):
                hashes, firsts, lo, hi, row, mark = _marked(block, symbols, gram, length)
                open_ = np.flatnonzero(mark == 1)
                counts = hi[open_] - lo[open_] + 1
                at = K.ranges(lo[open_], counts)
                owner = np.repeat(row[open_], counts)
                one = K.hash_spans(hashes, at, at + length)
                some = one % np.uint64(turns) == turn
                one, at, owner = one[some], at[some], owner[some]
                two = K.hash_spans(K.mix(hashes, 77), at, at + length)
                found.append((one, two, _rows(block, owner)[0], at - firsts[owner], owner + before))
            one, two, doc, place, owner = _joined(found)
            key, place = _own_keys(one, _decided(one ^ K.mix(two, 6), doc), doc, place)
            rest = pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield _with_key([K.as_long(key), rest, pa.array(doc), pa.array(place)], ["h1", "h2", "doc_id", "at"], batch, owner, keyed)

    some = marks.where(F.exists("marks", lambda m: m % 2 == 1))
    opened = source(docs, keyed).join(some, _key(keyed)).mapInArrow(run, "h1 long, h2 int, doc_id long, at int" + ", key long" * keyed)
    seen = opened.repartition("h1").withColumn("lo", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
    gone = seen.select(_key(keyed), F.when(F.col("at") < 0, -1 - F.col("at")).when(F.col("doc_id") > F.col("lo"), F.col("at")).alias("at"))
    return gone.where("at is not null").groupBy(_key(keyed)).agg(F.collect_list("at").alias("starts"))


def together(parts: list[DataFrame], name: str, keyed: bool = False) -> DataFrame:
    """One row a document, with the values of the turns' lists."""
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy(_key(keyed)).agg(F.flatten(F.collect_list(name)).alias(name))


def apply(docs: DataFrame, marks: DataFrame, starts: DataFrame, symbols: Symbols, gram: int, length: int, finish: Callable, schema: str, limit: int = K.CHUNK, keyed: bool = False) -> DataFrame:
    """finish(batch, firsts, gone) for batches of documents: gone marks the symbols that removed windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, min(limit, BLOCK)):
            hashes, firsts, lo, hi, row, mark = _marked(batch, symbols, gram, length)
            edge = np.zeros(len(hashes) + 1, np.int64)
            whole = np.flatnonzero(mark == 0)
            np.add.at(edge, lo[whole], 1)
            np.add.at(edge, hi[whole] + length, -1)
            sizes, values = _lists(batch.column("starts"))
            at = np.repeat(firsts[:-1], sizes) + values
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            yield finish(batch, firsts, np.cumsum(edge[:-1]) > 0)

    held = source(docs, keyed)
    if keyed:  # a null doc_id has a key too, but no marks
        held = held.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key")))
    held = held.join(marks, _key(keyed), "left").join(starts, _key(keyed), "left")
    return held.mapInArrow(run, schema)
