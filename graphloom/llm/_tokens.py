"""Exact token counts of whole texts under a byte-level BPE vocabulary.

Counting is the sum over the pieces that the vocabulary's pattern cuts a text into. Texts whose bytes are all
ASCII or Latin-1 letters, and have no apostrophe, are cut with numpy and each distinct piece is encoded once;
all other texts go through the tokenizer whole. Both give the tokenizer's own count.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa

from ._text import _CHARS, _TAB, buffers, chunks, mix

#: Folder of the public tokenizers' files; the operators take it as a parameter.
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLOTS = 1 << 20
_LETTER, _DIGIT, _SPACE, _OTHER, _BAD = range(5)


def _classes() -> bytes:
    out = bytearray([_BAD] * 256)
    for c in range(0x80):
        ch = chr(c)
        out[c] = _LETTER if ch.isalpha() else _DIGIT if ch.isdigit() else _SPACE if ch in " \t\n\r\x0b\x0c" else _OTHER
    for c in (0x1C, 0x1D, 0x1E, 0x1F, ord("'")):
        out[c] = _BAD
    for c in range(0x80, 0xC0):
        out[c] = _LETTER
    out[0xC3] = _LETTER
    return bytes(out)


CLASS = _classes()


class Counter:
    """Token counts under one vocabulary, with the counts of the pieces seen so far at fixed places of a table."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.key, self.value = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)

    def slow(self, text: str) -> int:
        return len(self.coder.encode_ordinary(text))

    def count(self, col: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Tokens of each text; 0 for a null or empty one."""
        offsets, raw = buffers(col)
        out = [self._chunk(offsets, raw, i, j) for i, j in chunks(offsets)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _chunk(self, offsets: np.ndarray, raw: np.ndarray, i: int, j: int) -> np.ndarray:
        lo, hi = int(offsets[i]), int(offsets[j])
        data, off, n = raw[lo:hi], offsets[i : j + 1] - lo, hi - lo
        blob = data.tobytes()
        kind = np.frombuffer(blob.translate(CLASS), np.uint8).copy()
        out = np.zeros(j - i, np.int64)
        if not n:
            return out
        # a second byte only after 0xC3, and neither of the two signs among the letters
        lead = data == 0xC3
        follows = np.concatenate([[False], lead[:-1]])
        second = (data >= 0x80) & (data < 0xC0)
        kind[(second & ~follows) | (second & ((data == 0x97) | (data == 0xB7)))] = _BAD
        bad = np.concatenate([[0], np.cumsum(kind == _BAD)])
        slow = bad[off[1:]] > bad[off[:-1]]
        for k in np.flatnonzero(slow):
            out[k] = self.slow(blob[off[k] : off[k + 1]].decode("utf-8", "replace"))
        # a piece starts where the class changes, at a text's start, and at the last blank before a word
        start = np.zeros(n + 1, bool)
        start[off] = True
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = kind[1:] != kind[:-1]
        text_start = start[:n].copy()
        space = kind == _SPACE
        begin = change | text_start
        end_of_space = np.zeros(n, bool)  # the last blank of a run that a word follows in the same text
        end_of_space[:-1] = space[:-1] & ~space[1:] & ~start[1:n]
        glue = end_of_space & (data == 32)
        start[:n] |= begin
        after = np.flatnonzero(end_of_space)
        start[after] = True  # that blank is a piece of its own, or the head of the next
        start[np.flatnonzero(glue) + 1] = False
        start[off] = True
        at = np.flatnonzero(start[:n])
        ends = np.append(at[1:], n)
        up, down = _CHARS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TAB[data] * up[:-1], out=sums[1:])
        h = mix((sums[ends] - sums[at]) * down[at]) | np.uint64(1)
        text = np.searchsorted(off, at, "right") - 1
        fast = ~slow[text]
        at, ends, h, text = at[fast], ends[fast], h[fast], text[fast]
        slot = (h >> np.uint64(44)).astype(np.int64)
        value = self.value[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = np.fromiter((self.slow_piece(blob[at[m] : ends[m]]) for m in miss[where].tolist()), np.int64, len(new))
            value[miss] = got[back]
            s = (new >> np.uint64(44)).astype(np.int64)
            self.key[s], self.value[s] = new, got  # of two pieces for one place the last stays, in both columns
        out += np.bincount(text, value, j - i).astype(np.int64)
        return out

    def slow_piece(self, piece: bytes) -> int:
        return self.slow(piece.decode())


_KNOWN: dict[str, Counter] = {}


def counter(name: str, folder: str = TOKENIZERS) -> Counter:
    """The counter of a vocabulary file, once for each Python worker."""
    path = os.path.join(folder, name)
    if path not in _KNOWN:
        _KNOWN[path] = Counter(path)
    return _KNOWN[path]
