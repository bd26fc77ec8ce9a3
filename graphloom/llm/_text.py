"""Vectorised word handling over Arrow string columns.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, lower-cased; everything
else separates words. Latin-1 capitals fold to small letters byte-wise. All functions work on whole
columns with numpy, so there is no Python loop over words, and none looks at a prefix only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are tokenised at once: small enough for the CPU caches, a longer text is one chunk of its own.
CHUNK = 1 << 20
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_P, _Q = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MASK = (1 << 64) - 1


def _fold_table() -> bytes:
    table = bytearray(b" " * 256)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalnum():
            table[c] = ord(chr(c).lower())
        elif c >= 0x80:
            table[c] = c + 0x20 if c < 0x9F else c
    return bytes(table)


FOLD = _fold_table()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit value over all bits."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_TAB = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inv)):
                f = np.full(size, b, np.uint64)
                f[0] = 1
                setattr(self, name, np.cumprod(f))
        return self.up[:n], self.down[:n]


_CHARS, _WORDS = _Powers(_P), _Powers(_Q)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets, raw


def chunks(offsets: np.ndarray, limit: int = CHUNK, most: int = 50_000):
    """Ranges (i, j) of texts that together have about ``limit`` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield i, j
        i = j


class Words:
    """The words of the texts i to j of a column: starts and ends in bytes, hashes, first word of each text."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, i: int, j: int):
        lo, hi = int(offsets[i]), int(offsets[j])
        folded = np.frombuffer(raw[lo:hi].tobytes().translate(FOLD), np.uint8)
        off = offsets[i : j + 1] - lo
        word = folded != 32
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        edges = np.unique(off[1:-1])
        inner = edges[(edges > 0) & (edges < len(folded))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text k are first[k] .. first[k + 1]
        self.first = np.searchsorted(self.starts, off)
        self.off, self.folded = off, folded
        up, down = _CHARS.get(len(folded) + 1)
        sums = np.zeros(len(folded) + 1, np.uint64)
        np.cumsum(_TAB[folded] * up[:-1], out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def text_of(self) -> np.ndarray:
        """For each word the number of its text, from 0."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on; windows that leave the column's chunk are absent."""
        return window_hashes(self.hash, length)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, for brute-force checks."""
    return (text or "").encode().translate(FOLD).split()
