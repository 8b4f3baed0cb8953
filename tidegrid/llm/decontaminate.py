"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Test items are lower-cased (A-Z) and cut into words; every run of `n` words is a
window, an item of fewer words is one window. The windows' hashes are broadcast in
blocks of about `block` windows (so each broadcast has a fixed bound; a worker holds
all of them, and no window is dropped). Each row is scanned whole against all blocks
in one pass, whatever its doc_id; hash hits are verified word by word.

Defined results: null text or item text has no words; an empty benchmark hits
nothing; repeated items count once per item_id; null item_ids are ignored; null and
repeated doc_ids get a row for each row; other columns of either table play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

BLOCK = 200_000
HITS = "doc_id long, n_words long, spans array<struct<first:int,count:int>>, items array<string>"
FIRST, SHIFT = 1 << 22, np.uint64(42)


class _Windows:
    """A block of benchmark windows: by length, sorted hashes with the words and items of each."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        self.by_length = {}
        for length in sorted({len(w) for w in windows}):
            words = [w for w in windows if len(w) == length]
            flat = b" ".join(b" ".join(w) for w in words)
            data = np.frombuffer(flat, np.uint8)
            starts, ends, _ = K.find_words(data, np.array([0, len(data)]), K.NON_WORD)
            hashes = K.mix(K.hash_windows(K.hash_spans(data, starts, ends), length)[::length])
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(FIRST, bool)
            maybe[(hashes >> SHIFT).astype(np.int64)] = True
            self.by_length[length] = (hashes[order], maybe, [words[i] for i in order], [sorted(windows[words[i]]) for i in order])


def item_windows(text: str | None, n: int) -> list[tuple[bytes, ...]]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    data = K.LOWER[data]
    starts, ends, _ = K.find_words(data, np.array([0, len(data)]), K.NON_WORD)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def _blocks(benchmark: DataFrame, n: int, block: int) -> Iterator[_Windows]:
    held: dict[tuple[bytes, ...], set[str]] = {}
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null").toLocalIterator():
        for window in item_windows(row.text, n):
            held.setdefault(window, set()).add(row.item_id)
        if len(held) >= block:
            yield _Windows(held)
            held = {}
    if held:
        yield _Windows(held)


def _found(blocks: list[_Windows], batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
    """Each row's first word, and the spans and items of the rows that windows of any block hit."""
    data, offsets = K.text_buffers(batch.column("text"))
    data = K.LOWER[data]
    starts, ends, firsts = K.find_words(data, offsets, K.NON_WORD)
    hashes = K.hash_spans(data, starts, ends)
    left = K.room(firsts)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for length, (known, maybe, words, owners) in (x for block in blocks for x in block.by_length.items()):
        found = K.mix(K.hash_windows(hashes, length))
        at = np.flatnonzero(maybe[(found >> SHIFT).astype(np.int64)])
        at = at[left[at] >= length]
        place = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
        hit = known[place] == found[at]
        for i, k in zip(at[hit], place[hit], strict=True):
            if all(data[starts[i + j] : ends[i + j]].tobytes() == words[k][j] for j in range(length)):
                doc = int(np.searchsorted(firsts, i, "right")) - 1
                own = spans.setdefault(doc, [])
                first = int(i - firsts[doc])
                if own and own[-1]["first"] <= first <= own[-1]["first"] + own[-1]["count"]:
                    own[-1]["count"] = max(own[-1]["count"], first + length - own[-1]["first"])
                else:
                    own.append({"first": first, "count": length})
                items.setdefault(doc, set()).update(owners[k])
    return firsts, spans, items


def _scan(shares):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [share.value for share in shares]
        for batch in K.pieces(batches):
            firsts, spans, items = _found(blocks, batch)
            rows = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(firsts)),
                    pa.array([spans.get(i, []) for i in rows], pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))),
                    pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    return run


def _shares(docs: DataFrame, benchmark: DataFrame, n: int, block: int) -> list:
    return [docs.sparkSession.sparkContext.broadcast(windows) for windows in _blocks(benchmark, n, block)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (word ranges that windows cover; they may overlap), items (ids with hits): a row for each document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(K.lean(_scan(_shares(docs, benchmark, n, block))), HITS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, digests = [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            covered, end = 0, 0
            for a, b in sorted((s["first"], s["first"] + s["count"]) for s in spans or ()):
                covered += max(0, b - max(a, end))
                end = max(end, b)
            hits.append(covered)
            digests.append(hashlib.sha256(",".join(sorted(items or ())).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x or ()) for x in batch.column("items").to_pylist()], pa.int64()), pa.array(digests), pa.array([x > 0 for x in hits], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, block: int = BLOCK) -> DataFrame:
    """docs without the words that benchmark windows cover: a touched document keeps its other words,
    joined by one space where words went; one left without words is dropped. Columns are those of docs."""
    shares = _shares(docs, benchmark, n, block)
    names, kinds = docs.columns, docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [share.value for share in shares]
        for batch in K.pieces(batches):
            texts, keep = [], []
            _, found, _ = _found(blocks, batch)
            for row, text in enumerate(batch.column("text").to_pylist()):
                spans = found.get(row)
                if spans:
                    raw = text.encode()
                    data = K.LOWER[np.frombuffer(raw, np.uint8)]
                    starts, ends, _ = K.find_words(data, np.array([0, len(data)]), K.NON_WORD)
                    at, parts, last = 0, [], 0
                    for a, b in sorted((s["first"], s["first"] + s["count"]) for s in spans):
                        b = max(b, last)
                        if a > last or not parts:
                            parts.append(raw[at : starts[a]])
                        at, last = int(ends[b - 1]), b
                    parts.append(raw[at:])
                    text = b" ".join(p.strip() for p in parts if p.strip()).decode()
                    rest = K.NON_WORD[np.frombuffer(text.encode(), np.uint8)]
                    keep.append(bool(len(rest)) and not rest.all())
                else:
                    keep.append(True)
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            out = pa.RecordBatch.from_arrays(cols, names)
            yield out.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(K.lean(cut), kinds)
