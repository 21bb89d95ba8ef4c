"""Word and shingle hashes of a batch of texts, computed on the UTF-8 bytes with numpy.

The hash of a word is a polynomial in its bytes modulo 2**64, mixed at the end. All words of a
piece come from one multiplication and one segmented sum, so the cost is a few passes over the
bytes, whatever the number of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time. A longer single word extends the tables.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Space and U+0009 to U+000D part words.
SPACES = bytes([32, 9, 10, 11, 12, 13])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Words:
    """Hashes words; ``drop`` are the bytes between words, ``lower`` folds A-Z."""

    def __init__(self, lower: bool = False, drop: bytes = SPACES):
        self.values = _VALUES.copy()
        if lower:
            self.values[65:91] = self.values[97:123]
        self.values[list(drop)] = 0
        self.inside = np.ones(256, bool)
        self.inside[list(drop)] = False
        self._tables(PIECE + 1)

    def _tables(self, n: int) -> None:
        self.power = _powers(int(_BASE), n)
        self.inverse = _powers(pow(int(_BASE), -1, 2**64), n)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words start (one more entry than texts)."""
        data, offsets = text_bytes(texts)
        inside = self.inside[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[firsts] = inside[firsts]
        starts = np.flatnonzero(begins)
        bounds = np.searchsorted(starts, offsets)
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            # whole words only: a piece ends where a word begins
            hi = max(int(np.searchsorted(starts, starts[lo] + PIECE)), lo + 1)
            s, e = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(data)
            if hi - lo > 1 and e - s > PIECE:
                hi -= 1
                e = int(starts[hi])
            if e - s > len(self.power):
                self._tables(e - s)
            terms = self.values[data[s:e]]
            terms *= self.power[: e - s]
            at = starts[lo:hi] - s
            out[lo:hi] = np.add.reduceat(terms, at) * self.inverse[at]
            lo = hi
        return mix(out), bounds


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; fewer words: one hash of the whole sequence, or none."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out += words[i : n - width + 1 + i] * _STEPS[i]
    return mix(out)
