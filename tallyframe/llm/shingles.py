"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
_mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """The words' hashes, in order: runs of anything but ASCII white space, A-Z in lower case."""
    words = text.encode().lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; of a shorter text's whole sequence; empty without words."""
    h = word_hashes(text) if text else np.empty(0, np.uint64)
    n = len(h)
    if n == 0:
        return h
    k = min(n, words)
    s = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        s += h[i : n - k + 1 + i] * _mix[i % len(_mix)] + np.uint64(i + k)
    s = np.sort(scrambled(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
