"""Word hashes and shingle sets of texts."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
MEMORY = 100_000  # words remembered, some 18 MB a worker


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    if len(_codes) > MEMORY:
        _codes.clear()
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def window_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words."""
    n = len(codes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out += codes[k : k + n] * _MULTIPLIERS[k]
    return mix(out)


def lowered(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, an empty one none."""
    words = lowered(text)
    if not words:
        return np.zeros(0, np.uint64)
    codes = word_codes(words)
    if len(words) < size:
        return mix((codes * _MULTIPLIERS[: len(words)]).sum(keepdims=True) + U(len(words)))
    return np.unique(window_codes(codes, size))
