"""Words, word shingles and their hashes over whole Arrow batches with numpy, without a Python loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; as those are ASCII, splitting UTF-8
bytes and splitting code points give the same words. A-Z is lower-cased, nothing else. Hashes have
64 bits; a word's is a polynomial over a random value for each byte, a shingle's mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 2**64)
#: White space and ASCII punctuation, for comparisons that ignore both.
MARKS = _SPACE.copy()
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in (("up", _BASE), ("down", _INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch: start and end (byte positions), row, hash, and each row's first word (first has one more entry).

    between: for each byte, whether it separates words.
    """

    def __init__(self, column: pa.Array, between: np.ndarray = _SPACE):
        data, off = utf8(column)
        self.data, self.off = data, off
        rows, n = len(off) - 1, len(data)
        inner = np.zeros(n + 2, bool)
        np.logical_not(between[data], out=inner[1:-1])
        begins, ends = inner[1:] & ~inner[:-1], inner[:-1] & ~inner[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[inner[cut] & inner[cut + 1]]  # a row ends and the next begins inside a run
        begins[cut] = ends[cut] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a row, in order, and each row's first; a row of fewer words has one run of them all, one without words none."""
        w, n = self.hash, np.diff(self.first)
        count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
        first = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(self.first[:-1] - first[:-1], count) + np.arange(first[-1])
        h = np.zeros(len(at), np.uint64)
        stop = np.repeat(self.first[1:], count)
        for i in range(k):
            inside = at + i < stop
            h = np.where(inside, self._follow(h, at + i, i) if len(w) else h, h)
        return h, first

    def _follow(self, h: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
        """Hashes h of i words with the words at `at` behind them."""
        return mix(h * np.uint64(0x9FB21C651E98DF25) + self.hash[np.minimum(at, max(len(self.hash) - 1, 0))] + np.uint64(i + 1))

    def seeds(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and of all k words of k + 1 in a row without an inner one; their rows, first words, and how many words they reach over. The same k words have one hash, with a gap or without."""
        h, first = self.shingles(k)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        parts = [(h, row, np.arange(len(h)) - first[row] + self.first[row], np.full(len(h), k))]
        at = np.arange(len(self.hash))
        at = at[at + k < self.first[self.row + 1]]
        for gap in range(1, k):
            h = np.zeros(len(at), np.uint64)
            for i, word in enumerate(w for w in range(k + 1) if w != gap):
                h = self._follow(h, at + word, i)
            parts.append((h, self.row[at], at, np.full(len(at), k + 1)))
        return tuple(np.concatenate(x) for x in zip(*parts))


def unique_sets(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct hashes, sorted."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        s = np.sort(h[a:b])
        out.append(s if b - a < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out
