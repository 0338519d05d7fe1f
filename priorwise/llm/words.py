"""Words of texts as arrays of 64-bit hashes, cut and hashed a batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers for combining the word hashes of a shingle by position.
MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k << 33)) % 2**64 | 1 for k in range(64)], dtype=np.uint64)

#: Bytes of words of letters and digits: A-Z are lowered, all bytes beyond ASCII belong to words, the rest separates.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class WordHashes(dict):
    """Hash of each word seen; emptied when it holds too many."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n] * MIX[0]
    for k in range(1, size):
        out += words[k : k + n] * MIX[k % len(MIX)] if k < len(MIX) else words[k : k + n] * np.uint64(2 * k + 1)
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
