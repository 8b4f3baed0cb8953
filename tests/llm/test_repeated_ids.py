"""Rows that repeat a doc_id with other texts, and fits that must not depend on the order of rows."""

import hashlib

import numpy as np
import pytest

from tidegrid.llm import quality, suffix_dedup


def plain(rows, length):
    """Bytes left of each row: those not covered by a string that also starts in a smaller doc_id."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                least[b[i : i + length]] = min(least.get(b[i : i + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("partitions", [1, 4])
@pytest.mark.parametrize("seed", range(3))
def test_byte_dedup_of_repeated_ids(spark, seed, partitions):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("abcé "), rng.integers(5, 90))) for _ in range(6)]
    said = ["".join(parts[i] for i in rng.integers(0, 6, rng.integers(0, 9))) for _ in range(40)]
    rows = [(int(rng.integers(0, 12)), t) for t in said] + [(None, said[0]), (None, said[1]), (3, None), (1, said[2]), (1, said[2]), (5, "x" * 3000), (4, "x" * 100_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert sorted(map(tuple, suffix_dedup.dedup(table).collect()), key=order) == sorted(plain(rows, 50), key=order)


def test_quality_fit_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(2)
    words = lambda k: " ".join(f"{'good' if k % 2 else 'BAD'}{w}" for w in rng.integers(0, 50, 40))
    rows = [(i, words(i)) for i in range(120)] + [(i, words(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    fits = [quality.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert [fits[0].score(t) for _, t in rows] == [fits[1].score(t) for _, t in rows]


@pytest.mark.parametrize("keyed", [False, True])
def test_byte_dedup_shuffles_in_turns(spark, keyed):
    """Every path is in one turn, with all others of its anchor, and the turns together remove what one shuffle does."""
    from tidegrid.llm import _repeats as R

    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcé "), rng.integers(5, 90))) for _ in range(9)]
    rows = [(k // 2 if keyed else k, "".join(parts[i] for i in rng.integers(0, 9, rng.integers(0, 12)))) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    turns = [R.paths(table, suffix_dedup.byte_symbols, 20, 50, keyed=keyed, turn=k, turns=3).collect() for k in range(3)]
    whole = R.paths(table, suffix_dedup.byte_symbols, 20, 50, keyed=keyed).collect()
    assert all(len(t) < len(whole) / 2 for t in turns) and sorted(r for t in turns for r in t) == sorted(whole)
    want = sorted(plain(rows, 50), key=order)
    assert any(r[2] for r in want)
    for n in (1, 3):
        assert sorted(map(tuple, suffix_dedup.dedup(table, turns=n).collect()), key=order) == want


def test_byte_dedup_hashes_blocks_and_combines_batches(spark):
    """Arrays of symbols have about a block's size; a passage that all documents share still meets as one row a batch."""
    from tidegrid.llm import _repeats as R

    def symbols(batch):
        hashes, firsts = suffix_dedup.byte_symbols(batch)
        if len(hashes) > 1 << 17 and batch.num_rows > 1:
            raise ValueError(f"{len(hashes)} symbols at once")
        return hashes, firsts

    rng = np.random.default_rng(6)
    said = "".join(rng.choice(list("abcdefgh "), 200))
    rows = [(k, "".join(rng.choice(list("abcdefgh "), 2000)) + said) for k in range(180)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = R.paths(table, symbols, 20, 50, suffix_dedup.LIMIT).collect()
    first = {r.path for r in found if r.doc_id == 0}
    shared = [r for r in found if r.doc_id == 179 and r.path in first]
    assert len(shared) > 5 and all(r.ordinal < 0 for r in shared)  # decided in the batch, though in another block
    marks = R.repeated(R.paths(table, symbols, 20, 50, suffix_dedup.LIMIT))
    R.windows(table, marks, symbols, 20, 50, suffix_dedup.LIMIT).collect()
    assert sorted(map(tuple, suffix_dedup.dedup(table).collect())) == plain(rows, 50)
