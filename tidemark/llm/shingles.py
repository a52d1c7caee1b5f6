"""Word shingles of texts as sorted arrays of 64-bit hashes (run inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import LOWER, UPPER

_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_SHORT = 0xD6E8FEB86659FD93
_33, _29 = np.uint64(33), np.uint64(29)


class WordIds(dict):
    """Hashes of words, remembered up to a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _33)) * _MIX1
    h = (h ^ (h >> _29)) * _MIX2
    return h ^ (h >> _33)


def shingle_set(text: str | None, n: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; of the whole sequence if it has fewer words.

    Words are runs of characters other than [\x20\x09-\x0D], with A-Z lower-cased: bytes.split() splits just there.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = h * _STEP + codes[k : len(words) - width + 1 + k]
    if width < n:
        h = h + np.uint64(_SHORT * width % 2**64)
    return np.unique(mix(h))
