"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its lines (paragraphs). Each paragraph is hashed to a
wide vector: 1 (a count, modulo 2**32), a 128-bit identity (two words modulo 2**64)
and 64 signed lanes (modulo 2**32) onto which each pair of neighbouring words adds
+1 or -1. A fingerprint is the sum of its paragraphs' vectors, so it does not depend
on their order, and adding or subtracting a paragraph's vector inserts or deletes it.
Likeness compares lanes: their squared distance estimates the word pairs in which
two documents differ, 1 - distance / (own + own) is clipped to [0, 1].

Defined results: null text is empty; an empty text has no paragraphs and the zero
fingerprint; fingerprints that are equal have likeness 1; a single document is its
own next document; rows that repeat a doc_id follow each other by text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K

LANES = 64
LINES = K.separators((0x0A, 0x0A))


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (n), identities (n x 2) and lanes (n x LANES) of whole texts: sums over their paragraphs."""
    n = len(texts)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ids, lanes, counts = np.zeros((n, 2), np.uint64), np.zeros((n, LANES), np.int32), np.zeros(n, np.uint32)
    if not len(data):
        return counts, ids, lanes
    # paragraphs: every line, blank ones too; a text's last line ends at its end
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets))
    starts = np.sort(np.concatenate((offsets[:-1][full], breaks + 1)))
    ends = np.sort(np.concatenate((offsets[1:][full], breaks)))
    doc = np.repeat(full, 1 + np.add.reduceat(np.concatenate((data == 10, [False])).astype(np.int64), offsets[:-1][full]))
    line = K.hash_spans(data, starts, ends)
    heads = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
    with np.errstate(over="ignore"):
        ids[full, 0] = np.add.reduceat(K.mix(line, 1), heads)
        ids[full, 1] = np.add.reduceat(K.mix(line, 2), heads)
    counts[full] = np.diff(np.append(heads, len(doc)))
    # word pairs within a paragraph; its first word pairs with the paragraph's start
    first, last, firsts = K.find_words(data, offsets, K.SPACES)
    if len(first):
        word = K.hash_spans(data, first, last)
        fresh = np.searchsorted(starts, first, "right")
        before = np.concatenate((np.zeros(1, np.uint64), word[:-1]))
        before[np.concatenate(([True], fresh[1:] != fresh[:-1]))] = 0
        pair = K.mix(word * np.uint64(K.BASE) + before, 3)
        sign = ((pair >> np.uint64(63)).astype(np.int64) * 2 - 1).astype(np.float64)
        place = np.repeat(np.arange(n), np.diff(firsts)) * LANES + (pair & np.uint64(LANES - 1)).astype(np.int64)
        total = np.bincount(place, weights=sign, minlength=n * LANES)
        lanes = total.astype(np.int64).astype(np.int32).reshape(n, LANES)
    return counts, ids, lanes


def to_hex(counts: np.ndarray, ids: np.ndarray, lanes: np.ndarray) -> list[str]:
    return [(int(c).to_bytes(4, "little") + i.tobytes() + v.tobytes()).hex() for c, i, v in zip(counts, ids, lanes, strict=True)]


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text, as `fingerprints` gives it."""
    return to_hex(*vectors([(text or "").encode()]))[0]


def _parts(mark: str) -> tuple[int, np.ndarray, np.ndarray]:
    raw = bytes.fromhex(mark)
    return int.from_bytes(raw[:4], "little"), np.frombuffer(raw[4:20], np.uint64), np.frombuffer(raw[20:], np.int32)


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of a's paragraphs with b's inserted (sign 1) or deleted (sign -1)."""
    (n, i, v), (m, j, w) = _parts(a), _parts(b)
    with np.errstate(over="ignore"):
        return to_hex([(n + sign * m) % (1 << 32)], [i + j if sign > 0 else i - j], [v + w if sign > 0 else v - w])[0]


def _likeness(a: tuple, b: tuple) -> np.ndarray:
    with np.errstate(over="ignore"):
        gap = ((a[2] - b[2]).astype(np.float64) ** 2).sum(1)
    own = (a[2].astype(np.float64) ** 2).sum(1) + (b[2].astype(np.float64) ** 2).sum(1)
    same = (a[0] == b[0]) & (a[1] == b[1]).all(1) & (gap == 0)
    return np.where(same, 1.0, np.clip(1 - gap / np.maximum(own, 1), 0, 1) * (own > 0))


def likeness(a: str, b: str) -> float:
    pa_, pb = _parts(a), _parts(b)
    return float(_likeness((np.array([pa_[0]]), pa_[1][None], pa_[2][None]), (np.array([pb[0]]), pb[1][None], pb[2][None]))[0])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.pieces(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(to_hex(*vectors(texts)))], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document: one pass, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_marks, "doc_id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """Rows of SCHEMA for documents with the text that follows each."""
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, nexts, strict=True)]
    raw = [t.encode() for t in edited]
    own, other = vectors([t.encode() for t in texts]), vectors(raw)
    chained = all(a is b for a, b in zip(texts[1:], nexts, strict=False))
    after = vectors([nexts[-1].encode()]) if chained else vectors([t.encode() for t in nexts])
    if chained:  # the next document's vector is at hand
        after = tuple(np.concatenate((a[1:], b)) for a, b in zip(own, after, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(to_hex(*own)), pa.array(to_hex(*other)), pa.array(_likeness(own, other)), pa.array(_likeness(own, after))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows but a partition's last, each with its successor."""
    ids, texts = [], []
    for batch in K.pieces(batches):
        ids += batch.column("doc_id").to_pylist()
        texts += [t or "" for t in batch.column("text").to_pylist()]
        if len(ids) > 1:
            yield _compare(ids[:-1], texts[:-1], texts[1:])
            ids, texts = ids[-1:], texts[-1:]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for a partition: its first text, its last id and text."""
    head = tail = None
    for batch in batches:
        if batch.num_rows:
            head = head if head is not None else batch.slice(0, 1).to_pylist()[0]
            tail = batch.slice(batch.num_rows - 1, 1).to_pylist()[0]
    if head is not None:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([head["text"] or ""]), pa.array([tail["doc_id"]], pa.int64()), pa.array([tail["text"] or ""])], ["part", "head", "doc_id", "text"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _compare(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("next").to_pylist())


def edits(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and its successor (SCHEMA).

    One range shuffle by doc_id orders the documents; only a partition's last document waits for the
    first text of the next partition, through a table of one row a partition."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    edges = ordered.mapInArrow(_edges, "part int, head string, doc_id long, text string")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(every))
    closing = edges.select("doc_id", "text", follows.alias("next")).mapInArrow(_close, SCHEMA)
    return ordered.mapInArrow(_inner, SCHEMA).unionByName(closing)


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
