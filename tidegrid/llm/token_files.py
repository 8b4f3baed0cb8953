"""Token ids in Arrow stream files of fixed-size-list batches.

Documents are ordered by doc_id (one range shuffle), encoded whole, ended with
`END`, and their ids packed without gaps into sequences of `SEQUENCE` ids. A shard
(one range partition) is one Arrow IPC stream: record batches of `ROWS` sequences
with two columns, ids fixed_size_list<uint16> (uint32 for vocabularies of over 65,536
ids) and mask fixed_size_list<bool> (false where the last sequence is padded). All full batches take the same number of bytes,
so sequence k lies at a computed offset and is read without a copy (`TokenFile`). A
second stream beside it holds doc_id, start and n_tokens of the shard's documents.

Shards are written to the folder that all executors share, under a temporary name
that is renamed when complete, so a repeated or speculative task leaves one whole
file. Only one row a shard (its counts) reaches the driver.

Defined results: null text is empty, and an empty text is its end id alone; rows
that repeat a doc_id are kept, in the order of their text's hash; an empty table
writes no shard and gives no rows; other columns play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._session import fresh_dir

SEQUENCE, ROWS, END, TOKENIZER = 1024, 256, 2, "byte_bpe_50k.json"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _batch(ids: np.ndarray, used: int) -> pa.RecordBatch:
    """Whole sequences of ids, of which `used` ids count."""
    mask = np.arange(len(ids)) < used
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids, mask)], ["ids", "mask"])


class Writer:
    """Packs documents' ids into one shard."""

    def __init__(self, files: fs.FileSystem, path: str, kind: type = np.uint16) -> None:
        self.kind = kind
        self.files, self.path, self.temporary = files, path, f"{path}.{uuid.uuid4().hex}"
        self.sinks = [files.open_output_stream(self.temporary + end) for end in (".ids", ".docs")]
        self.ids, self.docs = (pa.ipc.new_stream(s, c) for s, c in zip(self.sinks, (_batch(np.zeros(0, kind), 0).schema, INDEX), strict=True))
        self.rest, self.total, self.count = np.zeros(0, kind), 0, 0

    def add(self, doc_ids: list, ids: np.ndarray, firsts: np.ndarray) -> None:
        """ids of documents, END included; firsts: each document's first id, and the end."""
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(self.total + firsts[:-1]), pa.array(np.diff(firsts))], schema=INDEX))
        self.total += len(ids)
        self.count += len(doc_ids)
        held = np.concatenate((self.rest, ids.astype(self.kind)))
        step, at = SEQUENCE * ROWS, 0
        while len(held) - at >= step:
            self.ids.write_batch(_batch(held[at : at + step], step))
            at += step
        self.rest = held[at:].copy()

    def close(self) -> None:
        if used := len(self.rest):
            self.ids.write_batch(_batch(np.concatenate((self.rest, np.zeros(-used % SEQUENCE, self.kind))), used))
        for x in (self.ids, self.docs, *self.sinks):
            x.close()
        for end in (".ids", ".docs"):
            self.files.move(self.temporary + end, self.path + end)


class TokenFile:
    """Random access to the sequences of one shard; on a local file without copying."""

    def __init__(self, source: pa.NativeFile | str) -> None:
        self.source = pa.memory_map(source) if isinstance(source, str) else source
        self.schema = pa.ipc.read_schema(self.source)
        self.head = self.source.tell()
        self.size = self.source.size()
        self.step = 0
        if self.source.tell() < self.size:
            message = pa.ipc.read_message(self.source)
            if message is not None and message.type == "record batch":
                self.step = self.source.tell() - self.head

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        at = self.head + k // ROWS * self.step
        self.source.seek(at)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        ids, mask = (c.flatten().slice(k % ROWS * SEQUENCE, SEQUENCE) for c in batch.columns)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import Encoder

        files, root = _open(folder)
        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        for batch in K.pieces(batches):
            if writer is None:
                files.create_dir(root, recursive=True)
                encoder = Encoder(vocabulary)
                writer = Writer(files, f"{root}/shard-{shard:06d}", np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
            ids, firsts = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            spread = np.arange(len(firsts))
            ended = np.full(len(ids) + batch.num_rows, end, np.int32)
            ended[np.arange(len(ids)) + np.repeat(spread[:-1], np.diff(firsts))] = ids
            writer.add(batch.column("doc_id").to_pylist(), ended, firsts + spread)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/shard-{shard:06d}"]), pa.array([writer.count]), pa.array([writer.total])], ["shard", "path", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, *, vocabulary: str | None = None, end: int = END, shards: int | None = None) -> list:
    """Writes the shards; rows (shard, path, n_docs, n_tokens) in the order of doc_id."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return sorted(ordered.mapInArrow(K.lean(_write(folder, vocabulary or tokenizer_path(), end)), MANIFEST).collect())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            files, name = _open(path)
            with files.open_input_stream(name + ".ids") as a, files.open_input_stream(name + ".docs") as b:
                sequences, held, at = pa.ipc.open_stream(a), np.zeros(0, np.uint16), 0
                for docs in pa.ipc.open_stream(b):
                    starts, counts = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    need = int(starts[-1] + counts[-1]) if len(starts) else at
                    parts, have = [held], at + len(held)
                    while have < need:
                        ids, mask = (c.flatten() for c in sequences.read_next_batch().columns)
                        parts.append(ids.slice(0, mask.true_count).to_numpy())
                        have += len(parts[-1])
                    held = np.concatenate(parts)
                    wide = held.astype("<u4")
                    sums = [zlib.crc32(wide[s - at : s - at + c]) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                    held, at = held[need - at :].copy(), need
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + base), docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark, manifest: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    base, rows = 0, []
    for shard, path, _, n_tokens in manifest:
        rows.append((shard, path, base))
        base += n_tokens
    listed = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)), "shard")
    return listed.select("path", "base").mapInArrow(K.lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame) -> DataFrame:
    folder = fresh_dir(docs.sparkSession, "tokens")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_documents(docs.sparkSession, write_tokens(docs, folder))


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
