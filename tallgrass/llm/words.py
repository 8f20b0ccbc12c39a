"""Words of many texts at once, as NumPy arrays.

A slice of texts becomes one byte array. Word borders come from a table of 256
byte classes, and 64-bit polynomial hashes of words, word prefixes and word
windows come from prefix sums, so no Python code runs for each word.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Everything but space and \\x09-\\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII digits, a-z, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            powers = np.full(size, b, np.uint64)
            powers[0] = 1
            both.append(np.cumprod(powers, dtype=np.uint64))
        have = _POWERS[base] = (both[0], both[1])
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """``starts``, ``ends`` (in ``raw``) and ``doc`` (index of its text) of every word, in order."""

    BYTE_BASE = 0x9E3779B97F4A7C55
    WORD_BASE = 0xD6E8FEB86659FD95

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.texts = texts
        self.buffer = b"\n".join(texts)
        self.raw = np.frombuffer(self.buffer, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.cumsum(lengths + 1) - lengths - 1
        inside = np.zeros(len(self.raw) + 2, np.int8)
        inside[1:-1] = is_word[self.raw]
        steps = np.diff(inside)
        self.starts = np.flatnonzero(steps == 1)
        self.ends = np.flatnonzero(steps == -1)
        self.doc = np.searchsorted(self.text_starts, self.starts, "right") - 1
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of any spans."""
        powers, inverse = _powers(self.BYTE_BASE, len(self.raw) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.raw] * powers[: len(self.raw)], out=self._sums[1:])
        return mixed((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``k`` words within one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        powers, inverse = _powers(self.WORD_BASE, len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return first, mixed((sums[first + k] - sums[first]) * inverse[first])

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.texts))

    def per_text(self, weights: np.ndarray) -> np.ndarray:
        """Sums of a whole number for each word, by text."""
        return np.bincount(self.doc, weights, minlength=len(self.texts)).astype(np.int64)

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]
