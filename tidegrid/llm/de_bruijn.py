"""Substring dedup over words: a de Bruijn graph of token k-mers, compacted.

0. `shared`, `segments`: each k-mer has a minimizer, its `LENGTH * 2 // 5`-word gram of least
   hash, so equal k-mers have equal ones. Runs of k-mers with one minimizer are shuffled as
   one row; those whose minimizer only one document has cannot repeat in another, and their
   words are left out. What is left of each text is written as segments. It holds every
   occurrence of every k-mer that two documents have.
1. `edges`: each k-mer of `LENGTH` consecutive words of a segment is an edge between the nodes of its
   first and last `LENGTH - 1` words. Edges are named by 64-bit hashes and aggregated:
   the least and greatest document, one source coordinate (segment, position), and
   sums over all occurrences' coordinates, and over the coordinates one word on. Edges
   of one document only are dropped.
2. `paths`: an edge goes on to the next edge of its coordinate without a branch if the
   first one's sums of next coordinates are the second one's sums of coordinates: then
   every occurrence of either is an occurrence of both. Runs of such edges are compacted
   to one row, named by the first edge, with their number of edges.
3. `occurrences`: a join of all segments' edges with the first edges of paths gives
   each path's occurrences, one row each, whatever the path's length.
4. `verified`: the words at each occurrence's source coordinates are read and named by
   SHA-256; of each path and name the least document keeps its words, all greater ones
   lose them. Edges whose 64-bit names collide do not stay on one path and are told
   apart here, so no result rests on those names.

Each word is removed that a window covers whose words also start in a document with
a smaller doc_id, judged on the input. Aggregates combine before the shuffle (every
batch, too, gives an edge once, and a minimizer that it finds in two documents once), so
an edge that a third of all documents share is some rows a task; the joins are on keys that one side holds once, so adaptive
execution may split the other side's hot partitions where they are large enough; no
join is salted, so a hot passage's occurrences below that size are one task's.

Defined results: null, empty and blank texts have no words; texts of fewer words
than a window lose nothing; repeats inside one document (and rows that repeat one
doc_id, whatever their texts) are not removed, but each row is judged by its own
text; a null doc_id loses nothing and takes nothing from others; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._session import scratch, written

#: The shuffles of single edges go in TURNS parts of the names, one after the other, so that fewer of their files are on disk at a time
LENGTH, LIMIT, TURNS = 50, 2 << 20, 2
#: Bytes of text whose minimizers are found at a time, so that the arrays stay in the cache
BLOCK = 1 << 17
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
#: Sums over the occurrences of an edge in one batch; null where it occurs once
MANY = ("hi", "here_a", "here_b", "next_a", "next_b")
LOW = (1 << 32) - 1


def source(docs: DataFrame) -> DataFrame:
    """doc_id, key (names the row's doc_id and text), text."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("key"), text.alias("text"))


def word_symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_buffers(batch.column("text"))
    starts, ends, firsts = K.find_words(data, offsets, K.SPACES)
    return K.hash_spans(data, starts, ends), firsts


def _minimizers(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Name, row, first k-mer (in its text) and number of k-mers of each run of k-mers with one minimizer, of rows with a doc_id."""
    known, before, found = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False), 0, []
    for block in K.pieces([batch], BLOCK):
        symbols, firsts = word_symbols(block)
        name, _, lo, hi, row = K.anchors(symbols, firsts, max(1, length * 2 // 5), length, 32)
        new = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (lo[1:] != hi[:-1] + 1)))[: len(name)])  # a gram that returns within its k-mers is one run
        name, lo, row, hi = name[new], lo[new], row[new], hi[np.append(new[1:], len(name)) - 1] if len(name) else hi
        some = known[row + before]
        found.append((name[some], row[some] + before, (lo - firsts[row])[some], (hi - lo + 1)[some]))
        before += block.num_rows
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shared(docs: DataFrame, length: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, key, spans (at, n: first k-mer and number of k-mers) of the runs whose minimizer several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            name, row, at, n = _minimizers(batch, length)
            doc, key = batch.column("doc_id").fill_null(0).to_numpy()[row], batch.column("key").to_numpy()[row]
            order = np.argsort(name, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1]))[: len(name)])
            sure = np.zeros(len(name), bool)
            if len(name):
                met = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
                sure[order] = np.repeat(met, np.diff(np.append(first, len(name))))
            alone = sure.copy()  # decided here: one row of the batch tells the others, the rest go by names of their own
            alone[order[first]] = False
            own = K.mix(key.view(np.uint64) * np.uint64(K.BASE) + at.astype(np.uint64), 31)
            yield pa.RecordBatch.from_arrays([K.as_long(np.where(alone, own, name)), pa.array(sure), pa.array(doc), pa.array(key), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["name", "sure", "doc_id", "key", "at", "n"])

    near = Window.partitionBy("name")
    rows = source(docs).mapInArrow(K.lean(run), "name long, sure boolean, doc_id long, key long, at int, n int").repartition("name")
    seen = rows.select("doc_id", "key", "at", "n", F.min("doc_id").over(near).alias("lo"), F.max("doc_id").over(near).alias("hi"), F.max("sure").over(near).alias("sure"))
    return _lists(seen.where("sure or lo < hi"), "at", "n")


def segments(docs: DataFrame, spans: DataFrame, length: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, key (names the segment), text, own (the row's key), base (words before it) of the words that spans cover. No two segments share a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            data, offsets = K.text_buffers(batch.column("text"))
            starts, ends, firsts = K.find_words(data, offsets, K.SPACES)
            row, (at, n) = _flat(batch.column("spans"), "at", "n")
            lo = firsts[row] + at
            order = np.argsort(lo, kind="stable")
            lo, row, hi = lo[order], row[order], (lo + n - 1)[order]
            new = np.flatnonzero(np.concatenate(([True], lo[1:] - hi[:-1] >= length))[: len(lo)])
            last = hi[np.append(new[1:], len(lo)) - 1] if len(lo) else hi
            lo, row, raw = lo[new], row[new], data.tobytes()
            said = [raw[a:b] for a, b in zip(starts[lo].tolist(), ends[last + length - 1].tolist(), strict=True)]
            at, rows = (lo - firsts[row]).astype(np.int32), pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), pa.array(said, pa.string()), batch.column("key").take(rows), pa.array(at)], ["doc_id", "text", "own", "base"])

    held = source(docs).join(spans, ["doc_id", "key"]).mapInArrow(K.lean(run), "doc_id long, text string, own long, base int")
    return held.select("doc_id", F.xxhash64("doc_id", "own", "base").alias("key"), "text", "own", "base")


def _found(batch: pa.RecordBatch, length: int, turn: int) -> tuple[np.ndarray, ...]:
    """Name, doc_id, key and position of each edge of a batch whose name falls to the turn."""
    symbols, firsts = word_symbols(batch)
    names = K.mix(K.hash_windows(symbols, length))
    column = batch.column("doc_id")
    known = column.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), np.diff(firsts))[: len(names)]
    at = np.flatnonzero((K.room(firsts)[: len(names)] >= length) & known[row] & (names % np.uint64(TURNS) == turn))
    row = row[at]
    doc, key = column.fill_null(0).to_numpy()[row], batch.column("key").to_numpy()[row]
    return names[at], doc, key, (at - firsts[row]).astype(np.int32)


def coordinate(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(key, at) of longs, so that single occurrences are hashed behind the shuffle instead."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    seed = np.full(len(key), 42, np.uint64)
    for values in (key, at):
        h = (seed + five + np.uint64(8)) ^ (turn(values.astype(np.int64).view(np.uint64) * two, 31) * one)
        h = turn(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        seed = h ^ (h >> np.uint64(32))
    return seed


def edges(held: DataFrame, length: int, turn: int, limit: int = LIMIT) -> DataFrame:
    """edge, key, at (one source coordinate), here_a, here_b, next_a, next_b of each edge of several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            name, doc, key, at = _found(batch, length, turn)
            order = np.lexsort((at, key, name))
            name, doc, key, at = name[order], doc[order], key[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(name)))
            some = size > 1
            held = K.ranges(first[some], size[some])
            heads = np.cumsum(size[some]) - size[some]
            sums = []
            for on in (0, 1):
                value = coordinate(key[held], at[held].astype(np.int64) + on)
                for part in (value & np.uint64(LOW), value >> np.uint64(32)):
                    sums.append(np.add.reduceat(part, heads) if len(heads) else part)
            many = []
            for values in (np.maximum.reduceat(doc[held], heads) if len(heads) else doc[held], *sums):
                wide = np.zeros(len(first), np.int64)
                wide[some] = values.astype(np.int64)
                many.append(pa.array(wide))
            least = np.minimum.reduceat(doc, first) if len(first) else doc
            sums = pa.StructArray.from_arrays(many, names=list(MANY), mask=pa.array(~some))
            rows = pa.RecordBatch.from_arrays([pa.array(least), pa.array(key[first]), sums, K.as_long(name[first]), pa.array(at[first])], ["lo", "key", "many", "edge", "at"])
            yield rows.take(pa.array(np.argsort(order[first])))  # in the order of the text, whose ids and positions compress

    fields = ", ".join(f"{x}: long" for x in MANY)
    rows = held.select("doc_id", "key", "text").mapInArrow(K.lean(run), f"lo long, key long, many struct<{fields}>, edge long, at int").repartition("edge")
    here, on = F.xxhash64("key", F.col("at").cast("long")), F.xxhash64("key", F.col("at").cast("long") + 1)
    single = {"hi": F.col("lo"), "here_a": here.bitwiseAND(LOW), "here_b": F.shiftrightunsigned(here, 32), "next_a": on.bitwiseAND(LOW), "next_b": F.shiftrightunsigned(on, 32)}
    wide = rows.select("edge", "lo", "key", "at", *(F.coalesce(f"many.{c}", v).alias(c) for c, v in single.items()))
    sums = [F.sum(c).alias(c) for c in MANY[1:]]
    met = wide.groupBy("edge").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("key").alias("key"), F.min_by("at", "key").alias("at"), *sums)
    return met.where("lo < hi").drop("lo", "hi")


def paths(found: DataFrame) -> DataFrame:
    """edge (the first), n_edges of each unbranched run of edges."""
    along = Window.partitionBy("key").orderBy("at")
    goes_on = (F.lag("at").over(along) + 1 == F.col("at")) & (F.lag("next_a").over(along) == F.col("here_a")) & (F.lag("next_b").over(along) == F.col("here_b"))
    runs = found.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    return runs.groupBy("key", "run").agg(F.min_by("edge", "at").alias("edge"), F.count(F.lit(1)).cast("int").alias("n_edges")).select("edge", "n_edges")


def occurrences(held: DataFrame, compact: DataFrame, length: int, turn: int, limit: int = LIMIT) -> DataFrame:
    """edge, n_edges, doc_id, key, at of every occurrence of a path. Paths grow with the corpus, so they are merged at every size, never broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            name, doc, key, at = _found(batch, length, turn)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), K.as_long(name), pa.array(at)], ["doc_id", "key", "edge", "at"])

    return held.select("doc_id", "key", "text").mapInArrow(K.lean(run), "doc_id long, key long, edge long, at int").join(compact.hint("merge"), "edge")


def _lists(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*fields)).alias("spans"))


def _flat(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each span of a column of lists of spans (null: none), and the spans' fields."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    spans = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), [spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in fields]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, each with a space behind it."""
    if not len(starts):
        return b""
    last = np.cumsum(ends - starts + 1) - 1
    step = np.ones(last[-1] + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    step[0] = starts[0]
    step[last[:-1] + 1] = starts[1:] - ends[:-1]
    out = np.append(data, np.uint8(32))[np.cumsum(step, dtype=step.dtype)]  # with the byte behind each word, whatever it is
    out[last] = 32
    return out.tobytes()


def verified(held: DataFrame, met: DataFrame, length: int, limit: int = LIMIT) -> DataFrame:
    """edge, words (SHA-256 of the words at the coordinates), doc_id, key (the document's), at (in the document), n_edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            data, offsets = K.text_buffers(batch.column("text"))
            starts, ends, firsts = K.find_words(data, offsets, K.SPACES)
            row, (edge, at, n) = _flat(batch.column("spans"), "edge", "at", "n_edges")
            joined = _joined(data, starts, ends)
            upto = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # where each word begins: words end in a space
            lo = firsts[row] + at
            said = [hashlib.sha256(joined[a:b]).digest() for a, b in zip(upto[lo].tolist(), (upto[lo + n + length - 1] - 1).tolist(), strict=True)]
            rows, base = pa.array(row), batch.column("base").to_numpy()[row]
            columns = {"edge": pa.array(edge), "words": pa.array(said, pa.binary()), "doc_id": batch.column("doc_id").take(rows), "key": batch.column("own").take(rows), "at": pa.array((base + at).astype(np.int32)), "n_edges": pa.array(n.astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    both = held.join(_lists(met, "edge", "at", "n_edges"), ["doc_id", "key"])
    return both.mapInArrow(K.lean(run), "edge long, words binary, doc_id long, key long, at int, n_edges int")


def repeats(said: DataFrame) -> DataFrame:
    """doc_id, key, spans (at, n_edges) of the paths that a smaller document has too."""
    least = said.groupBy("edge", "words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    return _lists(said.join(least, ["edge", "words"]).where("doc_id > lo"), "at", "n_edges")


def _cut(docs: DataFrame, gone: DataFrame, length: int, digest: bool, limit: int = LIMIT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, limit):
            data, offsets = K.text_buffers(batch.column("text"))
            starts, ends, firsts = K.find_words(data, offsets, K.SPACES)
            row, (at, n) = _flat(batch.column("spans"), "at", "n_edges")
            edge, lo = np.zeros(len(starts) + 1, np.int64), firsts[row] + at
            np.add.at(edge, lo, 1)
            np.add.at(edge, lo + n + length - 1, -1)
            left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            heads = np.searchsorted(left, firsts)
            joined = _joined(data, starts[left], ends[left])
            upto = np.concatenate(([0], np.cumsum(ends[left] - starts[left] + 1)))[heads].tolist()
            texts = [joined[a : max(a, b - 1)] for a, b in zip(upto[:-1], upto[1:], strict=True)]
            kept = pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(firsts)), pa.array(np.diff(firsts) - np.diff(heads)), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return source(docs).join(gone, ["doc_id", "key"], "left").mapInArrow(K.lean(run), SCHEMA)


def dedup(docs: DataFrame, *, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space; with digest, their SHA-256) of every document."""
    with scratch() as keep:
        held = written(segments(docs, shared(docs, length), length), "segments")
        found = [written(edges(held, length, turn), "edges") for turn in range(TURNS)]
        compact = written(paths(reduce(DataFrame.unionByName, found)), "paths")
        met = reduce(DataFrame.unionByName, [written(occurrences(held, compact, length, turn), "occurrences") for turn in range(TURNS)])
        gone = keep(repeats(written(verified(held, met, length), "verified")), "repeats")
    return _cut(docs, gone, length, digest)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE doc_id > lo),
x AS (SELECT d.doc_id, u.p, u.t, c.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) u JOIN d USING (doc_id) LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS r, string_agg(t, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
