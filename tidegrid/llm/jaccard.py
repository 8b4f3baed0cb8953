"""N-gram Jaccard join on parity sketches.

A document is the set of its distinct word n-grams, as 64-bit hashes. Sets of size s
and t >= s with Jaccard similarity of at least r differ in at most s * (1 - r) / r
hashes. For each band of sizes the hash space is cut into a few more cells than that
bound; a cell of the sketch is the XOR of the hashes in it, and a difference can
change one cell only. So two similar sets of a band (or of neighbouring bands, where
both emit the smaller one's cells) agree in at least one cell that is not empty: a
join on (band, cell, XOR) finds every pair. A set whose hashes fill too few cells
also emits its empty ones, which keeps the pigeonhole exact.

Sets are nodes: copies share one. Of the sets that meet in a cell each is paired
with the cell's least set first; sketches sift these pairs, all hashes verify them.
Where that leaves a cell's sets in more than one class, the sets of different classes
are compared by their parity sketches (a few bits a hash, folded to one width), in
blocks bounded by count and by bytes. Pairs that their sketches allow are verified,
but for those of classes that nearer pairs join already; should one of these nearer
pairs fail, its cells are compared once more and every allowed pair is verified.
Classes are the connected components of verified links, so no link between different
texts is lost.

Defined results: null, empty or blank texts have the empty set, are linked with
nothing and are their own class; shorter texts than n words are one n-gram; copies
and repeated rows share a class; rows that repeat a doc_id with other texts are linked
each by its own text; rows without doc_id link like others but name no class (one of
such rows alone has a null component_id); ties need no order, as classes do not depend
on one; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._components import components
from ._session import free_name, keyed, scratch, written

GROUP, BYTES, TURNS = 1024, 8 << 20, 3
RATIO = 1.5
U = np.uint64


class Bands:
    """Bands of set sizes, and the number of cells of each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * RATIO)))
        self.lows = np.array(lows, np.int64)
        self.bound = (self.lows[1:] - 1) * (den - num) // num
        least = self.bound + 1
        self.cells = np.where(self.bound == 0, 1, np.ceil(least / -np.expm1(-self.lows[:-1] / least)).astype(np.int64) + 2)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def first(self, sizes: np.ndarray) -> np.ndarray:
        """The lowest band that holds a set small enough to be similar."""
        return self.of(-(-sizes * self.num // self.den))


def shingle_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, and where each document's begin (rows + 1 values)."""
    data, offsets = K.text_buffers(batch.column("text"))
    data = K.LOWER[data]
    starts, ends, firsts = K.find_words(data, offsets, K.SPACES)
    words = K.hash_spans(data, starts, ends)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    grams = K.mix(K.hash_windows(words, n))
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(cuts[-1], np.uint64)
    if len(short):
        out[cuts[short]] = K.hash_spans(words, firsts[short], firsts[short + 1])
    for i in np.flatnonzero(counts >= n):
        own = grams[firsts[i] : firsts[i] + sizes[i]]
        own = np.sort(own)
        out[cuts[i] : cuts[i + 1]] = own
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[cuts[:-1][sizes > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[cuts]


def set_ids(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(hashes, 11))))
    return K.mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64), 12)


def signatures(hashes: np.ndarray, cuts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Cell signatures of sets, and the set (its index) of each."""
    sizes = np.diff(cuts)
    full = np.flatnonzero(sizes)
    top, low = bands.of(sizes[full]), bands.first(sizes[full])
    sigs, owners = [], []
    for back in range(int((top - low).max()) + 1 if len(full) else 0):
        some = full[top - back >= low]
        band = bands.of(sizes[some]) - back
        cells = bands.cells[band]
        at = K.ranges(cuts[some], sizes[some])
        own = np.repeat(np.arange(len(some)), sizes[some])
        h = hashes[at]
        cell = ((h >> U(32)) * cells[own].astype(np.uint64)) >> U(32)  # ascending within a set, as its hashes are
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (cell[1:] != cell[:-1]))))
        place = K.mix((band[own[new]].astype(np.uint64) << U(44)) + cell[new], 21)
        sigs.append(K.mix(np.bitwise_xor.reduceat(h, new) ^ place, 22))
        owners.append(some[own[new]])
        filled = np.bincount(own[new], minlength=len(some))
        for i in np.flatnonzero(filled <= bands.bound[band]):
            empty = np.setdiff1d(np.arange(cells[i], dtype=np.uint64), cell[new][own[new] == i])
            sigs.append(K.mix(K.mix((U(band[i]) << U(44)) + empty, 21), 22))
            owners.append(np.full(len(empty), some[i]))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


NAMES = "doc_id long, key long, more int, n_shingles long, node long, sigs array<long>"


def _names(n: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a task gives a copied set its signatures once
        for batch in K.pieces(batches):
            hashes, cuts = shingle_sets(batch, n)
            names, sizes = set_ids(hashes, cuts), np.diff(cuts)
            fresh = []
            for x in names.tolist():
                fresh.append(x not in done)
                done.add(x)
            own = sizes * np.array(fresh, bool)
            sigs, owners = signatures(hashes[K.ranges(cuts[:-1], own)], np.concatenate(([0], np.cumsum(own))), bands)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(names)))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), K.as_long(sigs[np.argsort(owners, kind="stable")]))
            columns = [*(batch.column(c) for c in ("doc_id", "key", "more")), pa.array(sizes), pa.array(names.view(np.int64), mask=sizes == 0), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "more", "n_shingles", "node", "sigs"])

    return K.lean(run)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit sketch: each hash flips one of its bits, of which there are a power of two, 1024 at least, about 2 a hash."""
    bits = max(1024, 1 << int(2 * len(hashes) - 1).bit_length()) if len(hashes) else 1024
    flips = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits: its halves' XOR, until it has `words` words."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def near(a: np.ndarray, b: np.ndarray, s: int, t: int, num: int, den: int) -> bool:
    """False only if sets of s and t hashes with these sketches cannot be similar."""
    if min(s, t) * den < max(s, t) * num:
        return False
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()) * (num + den) <= (s + t) * (den - num)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches):
            hashes, cuts = shingle_sets(batch, n)
            own = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(cuts)), pa.array([parity(h).tobytes() for h in own], pa.binary()), pa.array([h.tobytes() for h in own], pa.binary())], ["node", "n", "sketch", "hashes"])
            yield out.filter(pa.array(set_ids(hashes, cuts).view(np.int64) == batch.column("node").to_numpy()))

    return K.lean(run)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, for sorted distinct hashes."""
    s, t = sorted((len(a), len(b)))
    if s * den < t * num:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * den >= num * (s + t - common)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, num, den) for x, y in zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return K.lean(run)


def _sift(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)
            keep = [near(x, y, s, t, num, den) for x, y, (s, t) in zip(_arrays(batch.column("x")), _arrays(batch.column("y")), sizes, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return K.lean(run)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b: nodes) of similar sets: sketches first, then all hashes of the pairs that are left.

    What the sketches leave is written, so that no task runs both Python steps at once, and so are the sets it names:
    most sets are in no such pair and are shuffled once at most."""
    x, y = (sets.select(F.col("node").alias(k), F.col("n").alias(c), F.col("sketch").alias(v)) for k, c, v in (("a", "s", "x"), ("b", "t", "y")))
    left = written(pairs.join(x, "a").join(y, "b").select("a", "b", "s", "t", "x", "y").mapInArrow(_sift(num, den), "a long, b long"), "sifted")
    named = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    own = written(sets.join(named, "node").select("node", "hashes"), "named")
    x, y = (own.select(F.col("node").alias(k), F.col("hashes").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return left.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(num, den), "a long, b long")


def block_pairs(nodes: np.ndarray, labels: np.ndarray, left: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], num: int, den: int, all_of_them: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different classes whose sketches allow similar sets: left ones with the others, or with each other where all are left.

    Pairs that are well inside the bound (the third value) join their classes here, nearest first, and further pairs
    of classes joined so are left out: they need no link if those pairs are similar. With all_of_them none is left out."""
    order = np.argsort(sizes, kind="stable")
    nodes, labels, left, sizes, sketches = nodes[order], labels[order], left[order], sizes[order], [sketches[i] for i in order]
    inner, found = bool(left.all()), [np.zeros((3, 0), np.int64)]
    widths = np.array([len(x) for x in sketches])
    begin = 0
    while begin < len(nodes):  # sets whose sketches are equally long; larger sets have no shorter ones
        words = int(widths[begin])
        stop = int(np.searchsorted(widths, words, "right"))
        # similar sets are at most sizes * den / num large; only larger or equal ones are looked for
        ends = np.searchsorted(sizes, sizes[begin:stop] * den // num, "right")
        rows = np.stack([fold(x, words) for x in sketches[begin : int(ends.max())]])
        for i in range(begin, stop):
            at = np.arange(i + 1, ends[i - begin])
            at = at[labels[at] != labels[i]] if inner else at[(labels[at] != labels[i]) & (left[at] != left[i])]
            if len(at):
                gap = np.bitwise_count(rows[at - begin] ^ rows[i - begin]).sum(1).astype(np.int64)
                fits = gap * (num + den) <= (sizes[at] + sizes[i]) * (den - num)
                if fits.any():
                    found.append(np.stack([np.full(int(fits.sum()), i), at[fits], gap[fits]]))
        begin = stop
    i, j, gap = np.concatenate(found, 1)
    sure = np.zeros(len(i), bool)
    if not all_of_them:
        bits = np.minimum(widths[i], widths[j]) * 64
        likely = -bits / 2 * np.log1p(-2 * np.minimum(gap / bits, 0.45))  # differences that flip so many bits
        sure = likely * (1 + 2 / np.sqrt(bits)) <= (sizes[i] + sizes[j]) * (den - num) / (num + den)
        first = np.lexsort((j, i, gap, ~sure))
        i, j, sure = i[first], j[first], sure[first]
        near, rest = [], np.flatnonzero(sure)
        a, b = labels[i], labels[j]
        while len(rest):
            k = rest[0]
            near.append(k)
            x, y = a[k], b[k]
            a[a == y] = x
            b[b == y] = x
            rest = rest[a[rest] != b[rest]]
        chosen = np.concatenate((np.array(near, np.int64), np.flatnonzero(~sure & (a != b))))
        i, j, sure = i[chosen], j[chosen], sure[chosen]
    return nodes[i], nodes[j], sure


def _blocks(num: int, den: int, all_of_them: bool):
    def run(table: pa.Table) -> pa.Table:
        nodes, labels, sizes = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        sketches = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sketch")]
        a, b, sure = block_pairs(nodes, labels, table.column("left").to_numpy(), sizes, sketches, num, den, all_of_them)
        sig = pa.array(np.repeat(table.column("sig").to_numpy()[:1], len(a)), pa.int64())
        if len(nodes) > 256:
            K.give_back()
        return pa.table({"sig": sig, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return run


def open_cells(met: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, all_of_them: bool = False) -> DataFrame:
    """sig, a, b, sure: pairs of sets that meet in a cell, are of different classes yet and may be similar.

    Of cells with the same sets (by two independent hashes of them), one is opened; its sets are compared in blocks of
    at most `GROUP` sets and about `BYTES` of sketches a side."""
    labelled = met.select("sig", "node", "n").join(labels, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("label"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"k{seed}") for seed in (1, 2)]
    cell = labelled.groupBy("sig").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi"), *marks)
    cell = cell.where("size > 2 and lo < hi").groupBy("size", "total", "k1", "k2").agg(F.min("sig").alias("sig"))
    parts = F.ceil(F.greatest(F.col("size") / GROUP, F.col("total") / (2 * BYTES))).cast("int")  # 4 bits a hash at most
    some = labelled.join(cell.select("sig", parts.alias("parts")), "sig").withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    some = some.select("sig", "node", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"))
    held = some.join(sets.select("node", "n", "sketch"), "node").groupBy("sig", "i", "j")
    return held.applyInArrow(_blocks(num, den, all_of_them), "sig long, a long, b long, sure boolean")


def _class_of(labels: DataFrame, node: str, name: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("component").alias(name))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of different classes, with the classes x and y."""
    both = pairs.join(_class_of(labels, "a", "x"), "a", "left").join(_class_of(labels, "b", "y"), "b", "left")
    return both.withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b")).where("x <> y")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: only the classes that these join are worked on."""
    bridges = written(apart(links, labels).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "bridges")
    if bridges.isEmpty():
        return labels
    joined = components(bridges)
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    lone = joined.join(labels.select("node"), "node", "left_anti")
    return written(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(lone), "labels")


def placed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, key, more, n_shingles, component_id of every row; key and more name its doc_id and text."""
    bands = Bands(num, den)
    with scratch() as keep:
        source = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        named = written(source.mapInArrow(_names(n, bands), NAMES), "names")
        cells = named.where(F.size("sigs") > 0).select("node", F.col("n_shingles").alias("n"), F.explode("sigs").alias("sig"))
        parts = []
        for turn in range(TURNS):  # a share of the signatures at a time, so that their shuffles are never on disk together
            some = cells.where(F.pmod("sig", F.lit(TURNS)) == turn)
            shared = some.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most").select("sig", "pivot")
            parts.append(written(some.join(shared, "sig").select("sig", "node", "n", "pivot").distinct(), "met"))
        met = functools.reduce(DataFrame.unionByName, parts)
        # the sets of the nodes that met any other, each from one of its documents
        chosen = named.where("node is not null").groupBy("node").agg(F.min(F.struct("key", "more")).alias("k")).join(met.select("node").distinct(), "node")
        texts = source.join(chosen.select("node", "k.key", "k.more"), ["key", "more"]).dropDuplicates(["key", "more", "node"]).select("node", "text")
        sets = written(texts.mapInArrow(_sets(n), "node long, n long, sketch binary, hashes binary"), "sets")
        pairs = met.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        labels = components(verified(pairs, sets, num, den))
        maybe = written(open_cells(met, labels, sets, num, den), "near")
        labels = merged(labels, verified(maybe.select("a", "b").distinct(), sets, num, den))
        # where a pair that was sure was not similar, pairs may have been left out: those cells give all of theirs
        failed = written(apart(maybe.where("sure"), labels).select("sig").distinct(), "failed")
        if not failed.isEmpty():
            again = open_cells(met.join(failed, "sig", "left_semi"), labels, sets, num, den, all_of_them=True)
            labels = merged(labels, verified(again.select("a", "b").distinct(), sets, num, den))
        rows = named.drop("sigs").join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
        least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
        return keep(rows.join(least, "class", "left").select("doc_id", "key", "more", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")), "classes")


def classes(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the class) of every document, where sets of word
    n-grams link at den * intersection >= num * union."""
    return placed(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each class the rows with the least doc_id stay; rows without doc_id stay."""
    key, more = free_name(docs, "key"), free_name(docs, "more")
    gone = placed(docs, n, num, den).where("component_id < doc_id").select(F.col("key").alias(key), F.col("more").alias(more)).distinct()
    return keyed(docs, key, more).join(gone, [key, more], "left_anti").select(*docs.columns)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)
