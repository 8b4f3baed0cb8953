"""Packings keep every limit, use every token once, and need no more sequences than best fit piece by piece."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegrid.llm import packing, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, task string, length string"


def plain(lengths, limits):
    """Vector best fit, one piece at a time."""
    whole, weights, bins = limits.vector(), np.array(limits.weights), []
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n])
        fits = [b for b in range(len(bins)) if (bins[b] >= item).all()]
        if not fits:
            bins.append(whole - item)
        elif limits.rule == "dot":
            best = max(fits, key=lambda b: (float((weights * (bins[b] / whole) * (item / whole)).sum()), -b))
            bins[best] = bins[best] - item
        else:
            best = min(fits, key=lambda b: (float((weights * ((bins[b] - item) / whole) ** 2).sum()), b))
            bins[best] = bins[best] - item
    return len(bins)


def spread(entries, histogram):
    """Pieces (length, sequence, offset) of a plan."""
    ends = defaultdict(list)
    for e in entries.tolist():
        ends[e[0]].append(e)
    for length, n in histogram.items():
        held = sorted(ends[length], key=lambda e: e[1])
        for (_, base, each, first, offset), stop in zip(held, [e[1] for e in held[1:]] + [n], strict=True):
            for k in range(stop - base):
                yield length, first + k // each, offset + k % each * length


def sound(pieces, limits):
    tokens, pieces_, attention = limits.vector()
    by = defaultdict(list)
    for length, sequence, offset in pieces:
        by[sequence].append((offset, length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens and len(held) <= pieces_ and sum(n * n for _, n in held) <= attention
    return len(by)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("pieces", "attention"), [(None, None), (4, None), (None, 9000), (5, 6000)])
@pytest.mark.parametrize("seed", range(4))
def test_plan_against_one_piece_at_a_time(rule, pieces, attention, seed):
    rng = np.random.default_rng(seed)
    limits = packing.Limits(128, pieces, attention, (1.0, 0.5, 0.25) if seed % 2 else (1.0, 0.001, 0.001), rule)
    most = 128 if not attention else int(attention**0.5)
    lengths = np.minimum(rng.geometric(0.03, 400 + 100 * seed), most)
    histogram = dict(Counter(lengths.tolist()))
    entries, sequences = packing.plan(histogram, limits)
    got = list(spread(entries, histogram))
    assert Counter(n for n, *_ in got) == histogram and sound(got, limits) == sequences
    assert sequences <= plain(lengths.tolist(), limits) * 1.02 + 1
    if rule == "norm":
        assert len(entries) <= 4 * len(histogram) + sequences // 2


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(7)
    share = np.maximum(1, rng.integers(0, 50, 1023))
    few, many = (packing.plan({n + 1: int(c) * k for n, c in enumerate(share)}, packing.Limits()) for k in (1, 100_000))
    total = sum((n + 1) * int(c) for n, c in enumerate(share))
    assert len(many[0]) <= 4 * 1023 and many[1] <= total * 100_000 / 1024 * 1.01 and few[1] <= total / 1024 * 1.01 + 1


def test_too_long_for_the_limits():
    with pytest.raises(ValueError, match="exceeds"):
        packing.plan({100: 1}, packing.Limits(128, attention=5000))


def rows():
    words = [f"word{i % 97} é{i}" for i in range(3000)]
    texts = ["", None, "one", " ".join(words), " ".join(words[:700]), *(" ".join(words[i : i + 7 * (i % 40)]) for i in range(120)), "日本 'll <|endoftext|>", "x" * 50_000]
    out = [(i, t, None, None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[7], (7, "other text", *out[7][2:]), (None, "no id", *out[7][2:])]


@pytest.mark.parametrize("partitions", [1, 6])
def test_documents(spark, partitions):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    want = Counter()
    for r in rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first)] + [(a, a + 1024) for a in range(first, len(ids), 1024)]):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = packing.pack(spark.createDataFrame(rows(), SCHEMA).repartition(partitions)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert sound([(r.length, r.sequence_id, r.offset) for r in got], packing.Limits()) <= sum(r.length for r in got) / 1024 * 1.01 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
