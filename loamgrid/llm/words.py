"""Words of a batch of texts as numpy arrays.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; the separators are ASCII,
so UTF-8 bytes can be cut without decoding.  All functions work on whole
texts; memory is bounded by slicing a batch to a few MB of text (a single
longer text forms a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 20
_U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_ODD = _U64(0x9E3779B97F4A7C15)
_ODD_INV = _U64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


_BYTE = mix(np.arange(1, 257, dtype=_U64))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _ODD), ("down", _ODD_INV)):
                a = np.full(max(n, _BLOCK + 1), base, _U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


powers = _Powers()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about ``limit`` bytes of text each, and one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets of the rows in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, (off - off[0] if len(off) else np.zeros(1, np.int64))


class Words:
    """Words of the rows of a text column.

    ``data``/``off``: bytes and row offsets; ``start``/``end``: byte span of each
    word; ``first``: n + 1 offsets of the rows' words; ``row``: the row of each word.
    """

    def __init__(self, column: pa.Array) -> None:
        self.data, self.off = text_bytes(column)
        inside = ~SPACE[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begin = self.off[:-1][self.off[:-1] < self.off[1:]]
        opens[begin] |= inside[begin]
        last = self.off[1:][self.off[:-1] < self.off[1:]] - 1
        closes[last] |= inside[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, equal on every executor."""
        out = np.empty(len(self.start), _U64)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + _BLOCK, "right")))
            part = self.data[base : self.end[j - 1]]
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, _U64)
            np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
            a, b = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * down[a]
            i = j
        return mix(out)

    def ends(self) -> np.ndarray:
        """For each word the index after the last word of its row."""
        return self.first[1:][self.row]


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive items, by start; they may cross rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    out, i = np.empty(n, _U64), 0
    seed = mix(np.array([salt + 1], _U64))
    while i < n:
        j = min(n, i + _BLOCK - width)
        part = hashes[i : j + width - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U64)
        np.cumsum(mix(part + seed) * up[:-1], out=sums[1:])
        out[i:j] = (sums[width : width + j - i] - sums[: j - i]) * down[: j - i]
        i = j
    return mix(out)
