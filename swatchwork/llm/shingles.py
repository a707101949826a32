"""Word shingles and MinHash signatures of whole texts, with NumPy inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from swatchwork.llm.caches import claim

_CACHE_WORDS = 100_000
_cache: dict[bytes, int] = {}

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def begin_task() -> None:
    claim("shingles", lambda: _cache.clear())


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8 (bytes.split and bytes.lower
    know just those ASCII characters)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word, the same in every process."""
    global _cache
    cache = _cache
    if len(cache) > _CACHE_WORDS:
        cache = _cache = {}
    out = [cache.get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = cache[w] = xxhash.xxh64_intdigest(w)
    return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingle_set(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle,
    a text without words has none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for k in range(min(size, len(h))):
        out = _mix(out * _MULT + h[k : k + n])
    return np.unique(out)


def hash_parameters(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """One 32-bit minimum for each pair (a, b); long sets go block by block."""
    low = np.full(len(a), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), block):
        part = shingles[None, i : i + block] * a[:, None]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)
