"""Vectorised text kernels shared by the operators.

Everything works on Arrow string buffers (bytes plus offsets), so a batch of
documents is hashed by a handful of array passes and no Python string is made.
Spans are hashed by polynomials modulo two primes; windows of fixed length by
polynomials modulo 2**64 over well-mixed symbols.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
#: Primes below 2**31 and a base for each
MODULI = ((2147483647, 1103515243), (2147483629, 1500450271))
SPAN = CHUNK + (CHUNK >> 2)
U = np.uint64


#: Bytes that a worker may keep between arrays, or between groups
HELD = 64 << 20


def give_back(but: int = 0) -> None:
    """Freed memory goes back to the system, all but so many bytes of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(but)


def hold() -> None:
    """Up to HELD bytes of what arrays free stay with the worker until give_back(), so that the next arrays need not be mapped anew."""
    with contextlib.suppress(OSError, AttributeError):
        for option, size in ((-3, HELD // 2), (-1, HELD)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            ctypes.CDLL(None).mallopt(option, size)


def one_thread() -> None:
    """numpy's matrix products keep to the task's own thread: on small blocks the others mostly wait, which costs CPU. Where its library is another one, nothing changes."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(str(path)).scipy_openblas_set_num_threads64_(1)


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """step, whose worker gives freed memory back to the system when it ends: workers outlive their steps."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def lean_group(step: Callable[..., pa.Table], but: int = 0) -> Callable[..., pa.Table]:
    """step on one group (one or two arguments, which Spark counts), with memory, all but so many bytes, given back before the next group."""

    def alone(table):  # Spark would read annotations
        try:
            return step(table)
        finally:
            give_back(but)

    def both(first, second):
        try:
            return step(first, second)
        finally:
            give_back(but)

    return alone if step.__code__.co_argcount == 1 else both


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: True for bytes that part words."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words of [^\x20\x09-\x0D]+
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    z = x + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each modulus, base**i and base**-i for i <= SPAN."""
    if not _powers:
        for prime, base in MODULI:
            tables = []
            for b in (base, pow(base, -1, prime)):
                table = np.ones(1, np.uint64)
                while len(table) <= SPAN:
                    table = np.concatenate((table, table * U(pow(b, len(table), prime)) % U(prime)))
                tables.append(table[: SPAN + 1].copy())
            _powers.append((tables[0], tables[1]))
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = CHUNK, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text each (one row at least)."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(text))
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and each document's first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = table[data]
    solid = ~gap
    first, last = solid.copy(), solid.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = solid[heads]
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def modulo(x: np.ndarray, prime: int) -> np.ndarray:
    """x % prime of 64-bit integers; numpy divides by a constant faster than it takes the rest."""
    return x - x // U(prime) * U(prime)


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The polynomial of each span, for each modulus."""
    if len(data) > SPAN:
        if len(starts) > 1:  # spans in halves, each over the data it needs
            half, out = len(starts) // 2, []
            for s, e in ((starts[:half], ends[:half]), (starts[half:], ends[half:])):
                low = int(s.min())
                out.append(_polynomials(data[low : int(e.max())], s - low, e - low))
            return [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(starts) == 1:  # one long span, piece by piece
            data, total = data[starts[0] : ends[0]], [0, 0]
            for at in range(0, len(data), SPAN):
                piece = data[at : at + SPAN]
                for k, v in enumerate(_polynomials(piece, np.zeros(1, np.int64), np.array([len(piece)]))):
                    prime, base = MODULI[k]
                    total[k] = (total[k] + int(v[0]) * pow(base, at, prime)) % prime
            return [np.array([t], np.uint64) for t in total]
        return [np.zeros(0, np.uint64)] * 2
    wide, out, total = data.dtype != np.uint8, [], np.zeros(len(data) + 1, np.uint64)
    narrow = None if wide else data.astype(np.uint64) + U(1)
    for (up, down), (prime, _), shift in zip(powers(), MODULI, (33, 2), strict=True):
        terms = modulo(((data >> U(shift)) & U((1 << 31) - 1)) * up[: len(data)], prime) if wide else narrow * up[: len(data)]
        np.cumsum(terms, out=total[1:])
        out.append(modulo(modulo(total[ends] - total[starts], prime) * down[starts], prime))
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; data: bytes or well-mixed uint64 symbols.

    Two polynomials modulo primes below 2**31 by prefix sums, so no texts collide by their structure alone."""
    one, two = _polynomials(data, starts, ends)
    with np.errstate(over="ignore"):
        return mix(((one << U(32)) | two) + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def hash_windows(symbols: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of symbols[i : i + length] for every i that fits, by doubling; not mixed."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, size = None, 0, symbols, 1
        while True:
            if length & size:
                piece = power[done : done + n]
                out = piece.copy() if out is None else out * U(pow(BASE, size, 1 << 64)) + piece
                done += size
            if size * 2 > length:
                return out
            power = power[:-size] * U(pow(BASE, size, 1 << 64)) + power[size:]
            size *= 2


def room(firsts: np.ndarray) -> np.ndarray:
    """For each symbol, how many follow in its document, itself included."""
    return np.repeat(firsts[1:], np.diff(firsts)) - np.arange(firsts[-1] - firsts[0])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i that fits."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(symbols: np.ndarray, firsts: np.ndarray, gram: int, window: int, bits: int = 0) -> tuple[np.ndarray, ...]:
    """Content-defined anchors: each window of `window` symbols of one document picks the first of
    its `gram`-symbol grams with the least hash, so equal windows pick the same gram at the same place.

    Returns, one value for each maximal run of window starts with one anchor: the gram's hash, its
    position, the first and last window start, and the document's row. bits: so many low bits of a hash
    are not compared, whatever the number of symbols (fewer than 2**bits); 0: as few as their number needs.
    """
    empty = np.zeros(0, np.int64)
    if len(symbols) < window:
        return empty.astype(np.uint64), empty, empty, empty, empty
    grams = mix(hash_windows(symbols, gram))
    bits = U(bits or max(1, int(len(grams)).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(packed, window - gram + 1)
    starts = np.flatnonzero(room(firsts)[: len(least)] >= window)
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty, empty
    at = (least[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(new[1:], len(starts)) - 1
    at = at[new]
    return grams[at], at, starts[new], starts[last], np.searchsorted(firsts, at, "right") - 1


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `count` values each, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
