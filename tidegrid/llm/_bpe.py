"""Fast byte-level BPE over batches of texts.

The tokenizers library does the BPE itself, once for each distinct piece of text; numpy
finds the pieces and looks up their ids. Pieces follow the byte-level pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ . Texts with code
points outside `SAFE` (whose Unicode classes could differ between versions), or with
an added token in them, go through the library whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from . import _kernel as K

#: Code points whose classes have long been fixed: up to Greek and Cyrillic, and general punctuation.
SAFE = ((0x0000, 0x0377), (0x0400, 0x052F), (0x2000, 0x206F), (0x20A0, 0x20AC), (0x2190, 0x21FF))
LETTER, NUMBER, SPACE, OTHER, UNSAFE = range(5)
#: White space of the pattern's \s
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
TABLE, LIMIT = 1 << 22, 2_400_000


def _classes() -> np.ndarray:
    table = np.full(0x2201, UNSAFE, np.uint8)
    for lo, hi in SAFE:
        for c in range(lo, hi + 1):
            kind = unicodedata.category(chr(c))[0]
            table[c] = SPACE if c in WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return table


def _letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes, self.byte_letters = _classes(), str.maketrans({i: c for i, c in enumerate(_letters())})
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(TABLE, np.uint64)
        self.slot = np.zeros(TABLE, np.int32)
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used, self.known = np.zeros(4096, np.int32), 0, 0

    def pieces(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions of code points at which a piece begins; firsts: each text's first code point, and the end."""
        kind = self.classes[np.minimum(codes, len(self.classes) - 1)]
        n = len(codes)
        head = np.zeros(n + 1, bool)
        head[firsts] = True
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start |= head
        space = kind == SPACE
        ends = np.flatnonzero(space & start[1:] & ~head[1:])  # the last of a white run that a text goes on after
        start[ends] = True
        start[ends[codes[ends] == 0x20] + 1] = False
        marks = np.flatnonzero((codes[: n - 1] == 0x27) & start[: n - 1] & (kind[1:] == LETTER) & ~head[1:n]) if n > 1 else ends[:0]
        if len(marks):
            a = codes[marks + 1]
            two = (marks + 2 < n) & ~head[np.minimum(marks + 2, n)]
            b = np.where(two, codes[np.minimum(marks + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            pair = ~one & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
            for which, length in ((one, 1), (pair, 2)):
                at = marks[which]
                start[at + 1] = head[at + 1]
                start[np.minimum(at + 1 + length, n)] = True
        return np.flatnonzero(start[:n])

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        model, table = self.tokenizer.model, self.byte_letters
        ids = [[t.id for t in model.tokenize(x.decode("latin-1").translate(table))] for x in texts]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        n, at = self.known + len(ids), self.used + len(flat)
        if n > len(self.first):
            self.first, self.size = (np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), np.int64))) for x in (self.first, self.size))
        if at > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(at, 2 * len(self.pool)) - len(self.pool), np.int32)))
        self.pool[self.used : at] = flat
        self.first[self.known : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.known : n] = sizes
        entry = np.arange(self.known, n)
        self.used, self.known = at, n
        place = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        while len(entry):  # each free slot takes one newcomer; the others move on
            free = np.flatnonzero(self.keys[place] == 0)
            _, chosen = np.unique(place[free], return_index=True)
            won = free[chosen]
            self.keys[place[won]] = hashes[won]
            self.slot[place[won]] = entry[won]
            left = np.ones(len(entry), bool)
            left[won] = False
            hashes, entry, place = hashes[left], entry[left], (place[left] + 1) & (TABLE - 1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        place = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        held = self.keys[place]
        hit = held == hashes
        out[hit] = self.slot[place[hit]]
        todo = np.flatnonzero(~hit & (held != 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & (TABLE - 1)
            held = self.keys[place[todo]]
            hit = held == hashes[todo]
            out[todo[hit]] = self.slot[place[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's first id (n + 1 values)."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        firsts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=firsts[1:])
        odd = np.flatnonzero(self.classes[np.minimum(codes, len(self.classes) - 1)] == UNSAFE)
        whole = sorted({*whole, *(np.searchsorted(firsts, odd, "right") - 1).tolist()})
        if whole:
            plain = sorted(set(range(len(texts))) - set(whole))
            ids, cuts = self.encode([texts[i] for i in plain]) if plain else (np.zeros(0, np.int32), np.zeros(1, np.int64))
            by = {i: ids[cuts[k] : cuts[k + 1]] for k, i in enumerate(plain)}
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                by[i] = np.array(e.ids, np.int32)
            sizes = np.array([len(by[i]) for i in range(len(texts))], np.int64)
            return np.concatenate([by[i] for i in range(len(texts))]), np.concatenate(([0], np.cumsum(sizes)))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.pieces(codes, firsts)
        width = np.ones(len(codes), np.int64)
        for bound in (0x80, 0x800, 0x10000):
            width += codes >= bound
        offset = np.concatenate(([0], np.cumsum(width)))
        raw = joined.encode()
        begin = offset[starts]
        end = np.append(begin[1:], len(raw))
        hashes = K.hash_spans(np.frombuffer(raw, np.uint8), begin, end)
        hashes[hashes == 0] = 1
        if self.known > LIMIT:
            self._clear()
        entry = self._find(hashes)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            new, where = np.unique(hashes[fresh], return_index=True)
            at = fresh[where]
            if self.known + len(new) > LIMIT * 3 // 2:
                self._clear()
                return self.encode(texts) if len(texts) == 1 or len(new) <= LIMIT else self._halves(texts)
            self._learn(new, [raw[begin[i] : end[i]] for i in at])
            entry[fresh] = self._find(hashes[fresh])
        sizes = self.size[entry]
        ids = self.pool[K.ranges(self.first[entry], sizes)]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, total[np.searchsorted(starts, firsts)]

    def _halves(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k = len(texts) // 2
        (a, b), (c, d) = self.encode(texts[:k]), self.encode(texts[k:])
        return np.concatenate((a, c)), np.concatenate((b, b[-1] + d[1:]))
