"""Masked pseudo-likelihood scoring: a bidirectional window network over counted tokens.

Every token is predicted from the tokens on either side of it, itself masked. Its
probability is P(class | `SIDE` tokens a side), from the network, times
P(token | class, neighbour on the left and on the right), from counts of the corpus. The
most frequent tokens are classes of their own, the rest share hashed classes. In a shared
class each side predicts the token itself: its count next to that neighbour, over the
count of its class there, each with `PRIOR` occurrences dealt by P(token | class); the
two predictions are averaged, so the probabilities of the tokens of a class add up to 1.
The occurrence that is scored is not counted among those next to its neighbours.

Tokens and pairs of neighbours are counted one by one (64-bit hashes of whole tokens),
however many the corpus has. It is cut into chunks of about `CHUNK` bytes of text. A chunk names its distinct
tokens and pairs once; these go to the shards of the hash range they fall in, which add up the
counts of all chunks and send every chunk the totals of its own. The number of shards
grows with the tokens, and no task or driver holds the counts of all of them. A shard
knows a token or pair by its number and the next 40 bits of its hash.

Fitting covers the whole corpus. Its documents are dealt by a hash of doc_id and text to
trainers, one for about `SHARE` bytes of text. Each trains its own copy of the network
(AdaGrad in numpy, all its documents in order of doc_id, one common start), and the copies are averaged
by their token counts in a tree of groups of `FAN` copies, so no task or driver
gathers more than that. Who trains on what, and in which order, depends on the documents
alone, so scores do not depend on how the input is split. The network (a hidden layer
with tanh) has one fixed size; it and the most frequent tokens are broadcast, nothing else.
Rows that repeat both doc_id and text share a trainer, which holds its share of the tokens in
one task; they are not salted.

Defined results: a null, empty or blank text has no tokens, pseudo-likelihood 0 and a
null mean; repeated rows are scored (and learned from) each; with no tokens at all
the untrained network scores; a token that the corpus lacks counts as half an
occurrence; docs that fit() has not seen (another DataFrame) leave no occurrence out; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._session import written

OWN, CLASSES, INPUTS, WIDTH, SIDE, STEP, RATE, FAN, BLOCK = 96, 128, 2048, 16, 2, 4096, 0.15, 64, 8192
CHUNK, SHARE, SHARD, LEAST, MOST, ROUNDS = 1 << 20, 1 << 24, 1 << 20, 9, 24, 4
#: Keys of one round have the first bits in common
TURN = np.uint64(64 - (ROUNDS.bit_length() - 1))
#: Chunks are scored in so many turns
TURNS = 5
#: Chunks in one Arrow batch
FEW = 4
#: Rows of class probabilities computed at a time, so that they stay in the cache
ROWS = 1024
#: exp() of it, and of its negative, is a normal 32-bit float
SAFE = 60.0
FREQUENT, SHARED = INPUTS // 2, CLASSES - OWN
PRIOR, EDGE = 4.0, np.uint64(0xE4D6E0FD0C5A9B37)
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
SHAPES = ((len(OFFSETS), INPUTS, WIDTH), (WIDTH, CLASSES), (CLASSES,))


class Vocabulary:
    """Classes and inputs of tokens, from the most frequent ones and the sums over the hashed classes."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """frequent: hashes, most frequent first, with their counts; sums: of counts + 0.5 of all tokens by hash % SHARED."""
        order = np.argsort(frequent)
        self.frequent, self.place = frequent[order], order
        own = counts[:OWN] + 0.5
        rest = sums - np.bincount((frequent[:OWN] % np.uint64(SHARED)).astype(np.int64), weights=own, minlength=SHARED)
        self.total = np.concatenate((own, np.zeros(OWN - len(own)), np.maximum(rest, 0.0)))
        self.start = np.log((self.total + 0.5) / (self.total + 0.5).sum()).astype(np.float32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and input of each token."""
        shared = OWN + (hashes % np.uint64(SHARED)).astype(np.int64)
        hashed = 1 + FREQUENT + (hashes % np.uint64(INPUTS - 1 - FREQUENT)).astype(np.int64)
        if not len(self.frequent):
            return shared.astype(np.uint8), hashed.astype(np.uint16)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        known, place = self.frequent[at] == hashes, self.place[at]
        return np.where(known & (place < OWN), place, shared).astype(np.uint8), np.where(known, 1 + place, hashed).astype(np.uint16)


@dataclass
class Model:
    """What fit() learned of docs; chunks has all of their tokens."""

    docs: DataFrame
    chunks: DataFrame
    vocabulary: Vocabulary
    weights: list[np.ndarray]

    def __iter__(self):
        return iter((self.vocabulary, self.weights))


def initial(vocabulary: Vocabulary) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    return [(rng.standard_normal(SHAPES[0]) * 0.1).astype(np.float32), (rng.standard_normal(SHAPES[1]) * 0.1).astype(np.float32), vocabulary.start.copy()]


def flatten(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unflatten(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape).astype(np.float32))
        at += n
    return out


def words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a batch's tokens, and each document's first token."""
    data, offsets = K.text_buffers(batch.column("text"))
    data = K.LOWER[data]
    starts, ends, firsts = K.find_words(data, offsets, K.SPACES)
    return K.hash_spans(data, starts, ends), firsts


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with places and counts, by sorting each key's upper bits together with its place."""
    low = np.uint64(max(1, len(keys).bit_length()))
    packed = (keys >> low << low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if (new[1:] & (ordered[1:] >> low == ordered[:-1] >> low)).any():  # keys that only the lower bits tell apart
        return np.unique(keys, return_inverse=True, return_counts=True)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ordered[starts], at, np.diff(np.append(starts, len(keys)))


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(np.append(starts, len(keys)))


CHUNKS = "chunk long, doc_id array<long>, sizes array<long>, ids binary, hashes binary, tokens long"
#: A chunk's number is its trainer's times 2**NUMBER, plus its place there
NUMBER = 32


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its documents, its distinct tokens in order of their hashes, and their places among them.

    Rows come in order of their trainer; a chunk ends with it, or with the document that fills CHUNK bytes."""
    K.hold()
    trainer, number = None, 0
    docs, found, sizes, held = [], [], [], 0

    def row() -> pa.RecordBatch:
        hashes, ids, _ = distinct(np.concatenate(found))
        values = [[trainer << NUMBER | number], [pa.concat_arrays(docs).to_pylist()], [np.concatenate(sizes)], [ids.astype(np.uint16 if len(hashes) <= 1 << 16 else np.uint32).tobytes()], [hashes.tobytes()], [len(ids)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["chunk", "doc_id", "sizes", "ids", "hashes", "tokens"])

    for batch in batches:
        ends = np.cumsum(np.diff(K.text_buffers(batch.column("text"))[1]) + 64)
        of, at = np.asarray(batch.column("trainer")), 0
        while at < len(of):
            if docs and (held >= CHUNK or of[at] != trainer):
                yield row()
                docs, found, sizes, held, number = [], [], [], 0, number + 1
            if of[at] != trainer:
                trainer, number = int(of[at]), 0
            before = ends[at - 1] if at else 0
            full = int(np.searchsorted(ends, before + CHUNK - held)) + 1
            to = min(full, len(of), int(np.searchsorted(of, trainer, "right")))
            for piece in K.pieces([batch.slice(at, to - at)]):
                hashes, firsts = words(piece)
                docs.append(piece.column("doc_id"))
                found.append(hashes)
                sizes.append(np.diff(firsts))
            held += int(ends[to - 1] - before)
            at = to
    if docs:
        yield row()


def chunked(docs: DataFrame) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = source.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    trainers = max(1, -(-held // SHARE))
    dealt = source.withColumn("name", F.xxhash64("doc_id", "text")).repartition(trainers, "name")  # a partition for each trainer
    ordered = dealt.sortWithinPartitions("doc_id", "name").withColumn("trainer", F.spark_partition_id())
    return written(ordered.select("doc_id", "text", "trainer").mapInArrow(K.lean(_cut), CHUNKS), "lm-chunks", 1000)


def _places(raw: bytes, n: int) -> np.ndarray:
    """The n tokens' places, of two bytes or four each."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct hashes, its tokens' places among them, and each document's first token."""
    firsts = np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64))))
    return np.frombuffer(row["hashes"], np.uint64), _places(row["ids"], int(firsts[-1])), firsts


def pack(counts: np.ndarray) -> bytes:
    """A byte for each count below 255; greater ones follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], np.int64)
    return counts


def packs(counts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """pack() of the counts up to each end, from the one before."""
    great = np.flatnonzero(counts >= 255)
    low, full = np.minimum(counts, 255).astype(np.uint8), counts[great].astype(np.int64)
    more, out, at, before = np.searchsorted(great, ends).tolist(), [], 0, 0
    for end, upto in zip(ends.tolist(), more, strict=True):
        out.append(low[at:end].tobytes() + full[before:upto].tobytes() if upto > before else low[at:end].tobytes())
        at, before = end, upto
    return out


def unpacks(raws: list[bytes], sizes: list[int]) -> np.ndarray:
    """The counts of many packs, one after the other."""
    counts = np.concatenate([np.frombuffer(r, np.uint8, n) for r, n in zip(raws, sizes, strict=True)]).astype(np.int64)
    full = [np.frombuffer(r[n:], np.int64) for r, n in zip(raws, sizes, strict=True) if len(r) > n]
    if full:
        counts[counts == 255] = np.concatenate(full)
    return counts


#: Bits of a name
NAME = 40
PIECES = "shard int, chunk long, n long, counted boolean, asks boolean, names binary, counts binary"


def pieces_of(keys: np.ndarray, counts: np.ndarray, chunk: int, bits: int, counted: bool, asks: bool) -> pa.RecordBatch:
    """The sorted keys of a chunk by shard: the first `bits` bits; in a shard the next 40 name a key, as what they exceed the last one's by."""
    edges = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
    names = (keys >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)
    heads = edges[:-1][edges[1:] > edges[:-1]]
    first = names[heads]
    names[1:] -= names[:-1].copy()
    names[heads] = first
    low, high = names.astype(np.uint32), (names >> np.uint64(32)).astype(np.uint8)
    full = np.flatnonzero(np.diff(edges))
    spans = [slice(edges[k], edges[k + 1]) for k in full]
    n = len(full)
    cols = [pa.array(full, pa.int32()), pa.array(np.full(n, chunk)), pa.array(np.diff(edges)[full], pa.int64()), pa.array(np.full(n, counted)), pa.array(np.full(n, asks)), pa.array([low[i].tobytes() + high[i].tobytes() for i in spans], pa.binary()), pa.array(packs(counts, edges[1:][full]), pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["shard", "chunk", "n", "counted", "asks", "names", "counts"])


def _names(raws: list[bytes], sizes: list[int]) -> np.ndarray:
    """The names of many pieces, one after the other."""
    low = np.concatenate([np.frombuffer(r, np.uint32, n) for r, n in zip(raws, sizes, strict=True)])
    high = np.concatenate([np.frombuffer(r, np.uint8, n, 4 * n) for r, n in zip(raws, sizes, strict=True)])
    names = np.cumsum(low | high.astype(np.uint64) << np.uint64(32))
    before = names[np.cumsum(sizes)[:-1] - 1]
    names[sizes[0] :] -= np.repeat(before, sizes[1:])
    return names


REPLIES = "chunk long, shard int, n long, counts binary"


def _add_up(table: pa.Table) -> pa.Table:
    """The totals, over all counted pieces of a shard, of the keys of each piece that asks."""
    K.hold()
    sizes, raws = table["n"].to_pylist(), table["counts"].to_pylist()
    counts = unpacks(raws, sizes) * np.repeat(np.asarray(table["counted"]).astype(np.int64), sizes)
    low = np.uint64(len(counts).bit_length())
    names = _names(table["names"].to_pylist(), sizes)
    if int(low) + NAME > 64:
        _, at, _ = distinct(names << np.uint64(24))
        total = np.bincount(at, weights=counts).astype(np.int64)[at]
    else:
        names <<= low
        names |= np.arange(len(names), dtype=np.uint64)
        names.sort()
        order = (names & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        names >>= low
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        total = np.empty(len(names), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.append(starts, len(names))))
    asks = np.flatnonzero(np.asarray(table["asks"]))
    packed = packs(total, np.cumsum(sizes))
    return table.select(["chunk", "shard", "n"]).take(asks).append_column("counts", pa.array([packed[k] for k in asks], pa.binary()))


def shard_bits(chunks: DataFrame) -> int:
    """So many that a shard has about SHARD distinct keys of all chunks."""
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    return min(MOST, max(LEAST, int(np.ceil(np.log2(max(1, 3 * tokens / SHARD))))))


def _tokens(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            hashes, ids = np.frombuffer(row["hashes"], np.uint64), _places(row["ids"], row["tokens"])
            edges = np.append(np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(hashes))
            full, counts = np.flatnonzero(np.diff(edges)), np.bincount(ids, minlength=len(hashes))
            spans = [slice(edges[k], edges[k + 1]) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.diff(edges)[full], pa.int64()), pa.array([hashes[i].tobytes() for i in spans], pa.binary()), pa.array(packs(counts, edges[1:][full]), pa.binary())], ["shard", "n", "names", "counts"])


TALLY = "hash long, n double, shared int"


def _tally():
    best = np.zeros(0)  # the FREQUENT greatest counts of this task so far

    def run(table: pa.Table) -> pa.Table:
        """A shard's tokens that may be among the FREQUENT most frequent of all, and the sums of counts + 0.5 of its tokens by hash % SHARED."""
        nonlocal best
        K.hold()
        rows = table.to_pylist()
        hashes, at, _ = distinct(np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows]))
        total = np.bincount(at, weights=unpacks([r["counts"] for r in rows], [r["n"] for r in rows]))
        best = np.sort(np.concatenate((best, total)))[-FREQUENT:]
        top = np.flatnonzero(total >= best[0]) if len(best) == FREQUENT else np.arange(len(total))
        top = top[np.lexsort((hashes[top], -total[top]))[:FREQUENT]]
        sums = np.bincount((hashes % np.uint64(SHARED)).astype(np.int64), weights=total + 0.5, minlength=SHARED)
        none = pa.nulls(len(top), pa.int32())
        return pa.table({"hash": pa.concat_arrays([K.as_long(hashes[top]), pa.nulls(SHARED, pa.int64())]), "n": pa.array(np.concatenate((total[top], sums))), "shared": pa.concat_arrays([none, pa.array(np.arange(SHARED), pa.int32())])})

    return run


def contexts(inputs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """tokens x sides: the inputs around each token; 0 beyond its document."""
    sizes = np.diff(firsts)
    padded = np.zeros(len(inputs) + SIDE * (len(sizes) + 1), np.uint16)
    at = np.arange(len(inputs)) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded[at] = inputs
    return np.stack([padded[at + o] for o in OFFSETS], 1)


def sides_of(around: np.ndarray) -> np.ndarray:
    """sides x tokens, in the form that numpy takes places in."""
    return np.ascontiguousarray(around.T, np.intp)


def hidden_of(weights: list[np.ndarray], sides: np.ndarray) -> np.ndarray:
    hidden = weights[0][0].take(sides[0], 0)
    for k in range(1, len(OFFSETS)):
        hidden += weights[0][k].take(sides[k], 0)
    return np.tanh(hidden, out=hidden)


def factors(weights: list[np.ndarray]) -> np.ndarray | None:
    """exp() of what each class has in every row; None where exp() of a whole logit may not be a normal number."""
    return np.exp(weights[2]) if (np.abs(weights[1]).sum(0) + np.abs(weights[2])).max() <= SAFE else None  # a hidden value is 1 at most


def logits(weights: list[np.ndarray], hidden: np.ndarray, scale: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of all classes, up to a constant of each row and the logarithms of the factors, which come second: products take them in."""
    z = hidden @ weights[1]
    if scale is None:
        z += weights[2]
        z -= z.max(1, keepdims=True)
        scale = np.ones(CLASSES, np.float32)
    return z, scale


def log_probabilities(weights: list[np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each row's target class."""
    out, known = np.empty(len(target), np.float32), factors(weights)
    for i in range(0, len(target), ROWS):
        mine = target[i : i + ROWS]
        z, scale = logits(weights, hidden_of(weights, sides_of(around[i : i + ROWS])), known)
        of = z[np.arange(len(z)), mine] + np.log(scale)[mine]
        out[i : i + ROWS] = of - np.log(np.exp(z, out=z) @ scale)
    return out


class Trainer:
    """AdaGrad over minibatches of tokens."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = [w.copy() for w in weights]
        self.square = [np.full(w.shape, 1e-4, np.float32) for w in weights]
        self.tokens = 0

    def gradients(self, around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean of -log P(target)."""
        n, sides, known = len(target), sides_of(around), factors(self.weights)
        back, out, bias = np.empty((n, WIDTH)), np.zeros(SHAPES[1], np.float32), np.zeros(SHAPES[2], np.float32)
        for i in range(0, n, ROWS):
            hidden, mine = hidden_of(self.weights, sides[:, i : i + ROWS]), target[i : i + ROWS]
            slope, scale = logits(self.weights, hidden, known)
            np.exp(slope, out=slope)
            total = slope @ scale
            slope[np.arange(len(slope)), mine] -= total / scale[mine]
            each = 1 / n / total  # a row's factor, as scale has the columns': the products are multiplied, not all slopes
            np.multiply((slope @ (self.weights[1] * scale).T) * (1 - hidden * hidden), each[:, None], out=back[i : i + ROWS])
            out += (hidden * each[:, None]).T @ slope
            bias += each @ slope
        out, bias = out * scale, bias * scale
        table, pairs = np.empty(SHAPES[0], np.float32), np.arange(WIDTH // 2)
        for k in range(len(OFFSETS)):  # a row's values are added by twos, as complex numbers
            sums = np.zeros(INPUTS * WIDTH // 2, np.complex128)
            np.add.at(sums, (sides[k][:, None] * len(pairs) + pairs).ravel(), back.view(np.complex128).ravel())
            table[k] = sums.view(np.float64).reshape(INPUTS, WIDTH)
        return [table, out, bias]

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        for w, s, g in zip(self.weights, self.square, self.gradients(around, target), strict=True):
            held = g * g
            s += held
            np.sqrt(s, out=held)
            g *= RATE
            g /= held
            w -= g
        self.tokens += len(target)


def vocabulary_of(chunks: DataFrame) -> Vocabulary:
    bits = shard_bits(chunks)
    pieces = chunks.select("tokens", "ids", "hashes").mapInArrow(K.lean(lambda batches: _tokens(batches, bits)), "shard int, n long, names binary, counts binary")
    tally = written(pieces.groupBy("shard").applyInArrow(K.lean_group(_tally(), K.HELD), TALLY), "lm-tally", FEW)
    top = tally.where("hash is not null").orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    sums = np.zeros(SHARED)
    for row in tally.where("shared is not null").groupBy("shared").agg(F.sum("n").alias("n")).collect():
        sums[row.shared] = row.n
    return Vocabulary(np.array([r["hash"] for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], float), sums)


def _train(share):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        K.one_thread()
        vocabulary, start = share.value
        trainer, part = Trainer(start), key[0].as_py()
        for row in sorted(table.to_pylist(), key=lambda r: r["chunk"]):
            hashes, ids, firsts = _read(row)
            cls, inp = vocabulary.places(hashes)
            around, target = contexts(inp[ids], firsts), cls[ids]
            for i in range(0, len(target), STEP):
                trainer.step(around[i : i + STEP], target[i : i + STEP])
        flat = flatten(trainer.weights).astype(np.float64) * trainer.tokens
        cuts = range(0, len(flat), BLOCK) if trainer.tokens else ()
        values = pa.array([flat[i : i + BLOCK].astype(np.float32).tobytes() for i in cuts], pa.binary())
        return pa.table({"block": pa.array(np.arange(len(cuts), dtype=np.int32)), "part": pa.array(np.full(len(cuts), part, np.int32)), "tokens": pa.array(np.full(len(cuts), trainer.tokens, np.int64)), "values": values})

    return run


def _sum(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    values = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in table.column("values").to_pylist()).astype(np.float32)
    return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64()), "values": pa.array([values.tobytes()], pa.binary())})


PARTS = "block int, part int, tokens long, values binary"


def fit(docs: DataFrame) -> Model:
    """The counted tokens and the averaged network of a corpus."""
    spark = docs.sparkSession
    chunks = chunked(docs)
    vocabulary = vocabulary_of(chunks)
    start = initial(vocabulary)
    share = spark.sparkContext.broadcast((vocabulary, start))
    trainer = F.shiftright("chunk", NUMBER).cast("int").alias("trainer")
    held = written(chunks.select(trainer, "chunk", "sizes", "ids", "hashes").groupBy("trainer").applyInArrow(K.lean_group(_train(share)), PARTS), "lm", FEW)
    most = held.agg(F.max("part")).first()[0]
    if most is None:
        return Model(docs, chunks, vocabulary, start)
    while True:
        held = held.groupBy("block", (F.col("part") / FAN).cast("int").alias("_group")).applyInArrow(_sum, PARTS)
        most //= FAN
        if not most:
            break
    rows = sorted(held.collect())
    flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]).astype(np.float64) / rows[0].tokens
    return Model(docs, chunks, vocabulary, unflatten(flat))


def occurrences(kinds: np.ndarray, hashes: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What is counted at every rare token (one of a shared class) of a chunk: itself, the pairs rare tokens are in, its class
    after its left and before its right neighbour, as numbers that key() takes; and its places among the pairs, as the second and the first. kinds: the tokens' classes."""
    sizes = np.diff(firsts)
    cls = kinds[ids]
    at = np.arange(len(ids)) + 1 + np.repeat(np.arange(len(sizes)), sizes)
    near = np.full(len(ids) + len(sizes) + 1, EDGE)
    near[at] = hashes[ids]
    rare = np.zeros(len(near), bool)
    rare[at] = cls >= OWN
    at, cls = np.flatnonzero(rare), cls[cls >= OWN].astype(np.uint64)
    paired = rare[:-1] | rare[1:]
    place = np.cumsum(paired) - 1
    with np.errstate(over="ignore"):
        up = near * np.uint64(K.BASE)
        return [near[at], (up[:-1] + near[1:])[paired], up[at - 1] + cls, up[at + 1] + cls], place[at - 1], place[at]


def key(numbers: np.ndarray, kind: int) -> np.ndarray:
    """The key of each number, one of the ROUNDS that its first bits name (they are those of a hash) and mixed below."""
    return (numbers >> TURN << TURN) | (K.mix(numbers, kind) >> (np.uint64(64) - TURN))


def keys_of(vocabulary: Vocabulary, hashes: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is counted of a chunk: its sorted keys, how often it has each, and the places of the five keys of every rare token."""
    kinds = vocabulary.places(hashes)[0]
    parts, second, first = occurrences(kinds, hashes, ids, firsts)
    rare = kinds >= OWN
    which = (np.cumsum(rare) - 1)[ids[rare[ids]]]
    parts[0] = hashes[rare]  # each once
    keys, found, counts = distinct(np.concatenate([key(p, k) for k, p in enumerate(parts)]))
    alone, pairs, left, right = np.split(found, np.cumsum([len(p) for p in parts[:-1]]))
    np.add.at(counts, alone, np.bincount(which, minlength=len(alone)) - 1)
    return keys, counts, np.stack([alone[which], pairs[second], pairs[first], left, right])


def within(vocabulary: Vocabulary, cls: np.ndarray, totals: np.ndarray, at: np.ndarray, own: int) -> np.ndarray:
    """log P(token | class, both neighbours) of rare tokens; own: occurrences of the corpus that are the scored one."""
    alone = np.minimum((totals[at[0]] + 0.5) / np.maximum(vocabulary.total[cls], 0.5), 1.0)
    sides = [(np.maximum(totals[at[k]] - own, 0) + PRIOR * alone) / (np.maximum(totals[at[k + 2]] - own, 0) + PRIOR) for k in (1, 2)]
    return np.log(np.minimum((sides[0] + sides[1]) / 2, 1.0))


def _pieces(share, bits: int, turn: int, counted: bool, asks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.hold()
        for batch in batches:
            for row in batch.to_pylist():
                hashes, ids, firsts = _read(row)
                found = occurrences(share.value[0].places(hashes)[0], hashes, ids, firsts)[0]
                keys, counts = tallied(np.concatenate([key(p[p >> TURN == turn], k) for k, p in enumerate(found)]))
                yield pieces_of(keys, counts, row["chunk"], bits, counted, asks)

    return run


def _score(share, own: int):
    def run(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        K.one_thread()
        K.hold()
        vocabulary, weights = share.value
        replies = replies.sort_by("shard")
        totals = unpacks(replies["counts"].to_pylist(), replies["n"].to_pylist()) if len(replies) else np.zeros(0, np.int64)
        out = []
        for row in chunks.to_pylist():
            hashes, ids, firsts = _read(row)
            cls, inp = vocabulary.places(hashes)
            around, target = contexts(inp[ids], firsts), cls[ids]
            logs = np.zeros(len(ids) + 1)
            logs[1:] = log_probabilities(weights, around, target)
            rare = np.flatnonzero(target >= OWN)
            if len(rare):
                logs[1 + rare] += within(vocabulary, target[rare], totals, keys_of(vocabulary, hashes, ids, firsts)[2], own)
            logs, n = np.cumsum(logs), np.diff(firsts)
            total = np.where(n > 0, logs[firsts[1:]] - logs[firsts[:-1]], 0.0)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            out.append(pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "n_tokens": pa.array(n), "pseudo_log_likelihood": pa.array(total), "mean_log_probability": mean}))
        return pa.concat_tables(out)

    return run


def _replies(chunks: DataFrame, model: Model, share, own: bool, turn: int) -> DataFrame:
    """The totals of every chunk's keys in one of the ROUNDS parts of the shards, kept so that the shuffle of the keys can go."""
    bits, names = shard_bits(model.chunks), ["chunk", "sizes", "ids", "hashes"]
    pieces = chunks.select(names).mapInArrow(K.lean(_pieces(share, bits, turn, own, True)), PIECES)
    if not own:
        pieces = pieces.unionByName(model.chunks.select(names).mapInArrow(K.lean(_pieces(share, bits, turn, True, False)), PIECES))
    return written(pieces.groupBy("shard").applyInArrow(K.lean_group(_add_up, K.HELD), REPLIES), "lm-counts", FEW)


SCORES = "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability of every document."""
    own = docs is model.docs
    chunks = model.chunks if own else chunked(docs)
    share = docs.sparkSession.sparkContext.broadcast(tuple(model))
    replies = None
    for turn in range(ROUNDS):
        some = _replies(chunks, model, share, own, turn)
        replies = some if replies is None else replies.unionByName(some)
    scored, trainers = None, ((chunks.agg(F.max("chunk")).first()[0] or 0) >> NUMBER) + 1
    for turn in range(TURNS):  # every chunk is in one turn; only one turn's shuffle files are on disk at a time
        first, end = (k * trainers // TURNS << NUMBER for k in (turn, turn + 1))
        mine = (F.col("chunk") >= first) & (F.col("chunk") < end)  # whole files: the others' statistics rule them out
        some = chunks.where(mine).groupBy("chunk").cogroup(replies.where(mine).groupBy("chunk")).applyInArrow(K.lean_group(_score(share, int(own)), K.HELD), SCORES)
        some = written(some, "lm-scores", FEW)
        scored = some if scored is None else scored.unionByName(some)
    return scored


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
