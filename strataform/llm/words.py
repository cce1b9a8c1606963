"""Words as 64-bit hashes, and shingles of them."""

from __future__ import annotations


import numpy as np
import xxhash

from strataform.llm.common import Memo, held

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _memo() -> Memo:
    return held("word hashes", lambda: Memo(xxhash.xxh64_intdigest, size=100_000))


def split(text: str) -> list[bytes]:
    """Lower-cases A to Z and splits at the bytes 9 to 13 and 32."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; a shorter text is one shingle, one without words none."""
    h = hashes(split(text)) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        total = total * _ODD[j % len(_ODD)] + h[j : len(h) - n + 1 + j]
    return np.unique(mix(total))
