"""Words of many texts at once: the runs of a-z and 0-9 of the lower-cased text, as 64-bit hashes in one array."""

from __future__ import annotations

import numpy as np

from lodestone.llm.spans import powers

_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(97, 123)]] = True
MIX = np.uint64(0xD6E8FEB86659FD93)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words one after another, and where each text's words begin (one more entry than texts)."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    a = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    n = len(a)
    p, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(a.astype(np.uint64) * p[:n], out=sums[1:])
    mask = np.concatenate(([False], _is_word[a], [False]))
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    start, end = edges[::2], edges[1::2]
    h = (sums[end] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(31))) * MIX
    firsts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)))
    return h ^ (h >> np.uint64(29)), np.searchsorted(start, firsts)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; runs across texts are among them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = len(h) - k + 1
    g = h[:m].copy()
    for i in range(1, k):
        g = (g * MIX) ^ (g >> np.uint64(29)) ^ h[i : i + m]
    g = (g ^ (g >> np.uint64(32))) * MIX
    return g ^ (g >> np.uint64(29))
