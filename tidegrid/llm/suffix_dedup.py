"""Substring dedup over bytes, on content-defined anchors.

This is not bucket-pointer refinement: no suffixes are sorted by pairs of bucket
identifiers. Each 50-byte window picks the q-gram of least hash in it; runs of windows
with one pick are named by a hash of all their bytes, and only runs that differ
between documents are opened into single windows, named by 96 bits. Only the q-grams'
hashes are made by doubling. The README gives the reason; see `_repeats` for the steps.

Each byte is removed that a 50-byte string covers which also starts in a document
with a smaller doc_id, judged on the input; matches never cross documents.

Defined results: null text is empty; texts shorter than a window lose nothing;
repeats inside one document (and among rows of one doc_id, whatever their texts) are
not removed; rows that repeat a doc_id with different texts are each judged by their own
text; a null doc_id loses nothing and takes nothing from others; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernel as K
from . import _repeats as R
from ._session import written

LENGTH, QGRAM, LIMIT, TURNS = 50, 20, 1 << 20, 2
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def byte_symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_buffers(batch.column("text"))
    return _SYMBOLS[data], offsets


_SYMBOLS = K.mix(np.arange(256, dtype=np.uint64), 9)


def _finish(batch: pa.RecordBatch, firsts: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    data, _ = K.text_buffers(batch.column("text"))
    total = np.concatenate(([0], np.cumsum(gone)))
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    heads = firsts[:-1][np.diff(firsts) > 0]
    first[heads] = gone[heads]
    spans = np.concatenate(([0], np.cumsum(first)))
    kept = data[~gone].tobytes()
    cuts = (firsts - total[firsts]).tolist()
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(firsts)), pa.array(total[firsts[1:]] - total[firsts[:-1]]), pa.array(spans[firsts[1:]] - spans[firsts[:-1]]), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, *, length: int = LENGTH, qgram: int = QGRAM, turns: int = TURNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document. turns: shuffles of paths, and of windows, one after the other; the result does not depend on it."""
    keyed = R.mixed(docs)
    marks = R.together([written(R.repeated(R.paths(docs, byte_symbols, qgram, length, LIMIT, keyed, k, turns), keyed), "marks") for k in range(turns)], "marks", keyed)
    marks = written(marks, "marks") if turns > 1 else marks
    starts = R.together([written(R.windows(docs, marks, byte_symbols, qgram, length, LIMIT, keyed, k, turns), "starts") for k in range(turns)], "starts", keyed)
    return R.apply(docs, marks, starts, byte_symbols, qgram, length, _finish, SCHEMA, LIMIT, keyed)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


