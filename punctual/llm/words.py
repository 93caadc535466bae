"""Words of many texts at once, found on their UTF-8 bytes.

A word is a run of ASCII digits and letters and of bytes from 128 on, with A-Z in lower
case: the pattern ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_TO_SPACE = bytes(b if _IS_WORD[b] else 32 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of several texts: ``first`` and ``last`` byte of each word in ``raw``,
    a hash of each, and the number of the text it is in."""

    def __init__(self, texts: list[bytes], hashes: bool = True):
        self.raw = b"\0".join(texts).translate(_LOWER) + b"\0"
        data = np.frombuffer(self.raw, np.uint8)
        inside = _IS_WORD[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.first, self.last = edges[::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.text = np.searchsorted(ends, self.first, side="right")
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = self._hashes(data) if hashes else None

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        sizes = self.last - self.first
        out = np.full(len(sizes), 0xCBF29CE484222325, np.uint64) + sizes.astype(np.uint64)
        # Eight bytes at a time: few words are longer than three such steps.
        padded = np.append(data, np.zeros(8, np.uint8))
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        todo, at = np.arange(len(sizes)), self.first.copy()
        while len(todo):
            left = self.last[todo] - at
            part = np.ascontiguousarray(eight[at]).view(np.uint64).reshape(-1)
            keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
            part = np.where(keep == 64, part, part & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))
            out[todo] = mixed((out[todo] ^ part) * MULTIPLIER)
            more = left > 8
            todo, at = todo[more], at[more] + 8
        return out


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).translate(_TO_SPACE).split()
