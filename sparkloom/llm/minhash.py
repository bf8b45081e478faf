"""Shingle sets, minwise signatures and their bands, shared by the near-copy operators.

A signature of ``bands * rows`` minima is cut into bands; two sets of similarity s agree in at least one band with
probability 1 - (1 - s^rows)^bands. Whatever bands bring together is verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\W_]+")


def char_shingles(text: str, size: int = 3) -> np.ndarray:
    """The distinct runs of ``size`` (at most 3) characters of ``text``, each packed exactly into 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < size:
        return np.zeros(0, dtype=np.uint64)
    packed = np.zeros(len(points) - size + 1, dtype=np.uint64)
    for k in range(size):
        packed = (packed << np.uint64(21)) | points[k : len(points) - size + 1 + k]
    return np.unique(packed)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def word_shingles(words: list[str], size: int = 5) -> np.ndarray:
    """The distinct runs of ``size`` words as 64-bit hashes; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - size + 1)
    runs = {" ".join(words[i : i + size]) for i in range(n)}
    return np.unique(np.array([int.from_bytes(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for r in runs], dtype=np.uint64))


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of a set that isn't empty."""
    a, b = _permutations(n)
    with np.errstate(over="ignore"):
        h = shingles ^ (shingles >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return (np.multiply.outer(a, h) + b[:, None]).min(axis=1)


def bands(shingles: np.ndarray, n_bands: int, rows: int) -> list[int]:
    """One signed 64-bit hash for each band; none for an empty set."""
    if not len(shingles):
        return []
    sig = signature(shingles, n_bands * rows).reshape(n_bands, rows)
    h = np.arange(1, n_bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in sig.T:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h.view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The exact similarity of two sorted sets; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
