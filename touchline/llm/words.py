"""Words of texts as UTF-8 byte strings, and hashes of words and windows.

Hashes only find candidates or groups; what must be exact is compared word by
word afterwards.
"""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15

#: Letters, digits and everything beyond ASCII make words; A-Z are lower-cased.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
_CONTINUATION = bytes(range(0x80, 0xC0))


def spaced_words(text: bytes) -> list[bytes]:
    """Words between white space (space and \\x09 to \\x0D)."""
    return text.split()


def spaced(text: bytes) -> bytes:
    """The text, lower-cased, with a space for every byte that is in no word."""
    return text.translate(_ALNUM)


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return spaced(text).split()


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hash of each ``n`` consecutive values: sum of h[i + k] * base ** k.

    Built from windows of 1, 2, 4 ... values, so the cost is log(n) passes.
    """
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total, done, block, width = np.zeros(size, np.uint64), 0, h, 1
    while width <= n:
        if n & width:
            total += np.uint64(pow(base, done, 1 << 64)) * block[done:done + size]
            done += width
        if 2 * width <= n:
            block = block[:-width] + np.uint64(pow(base, width, 1 << 64)) * block[width:]
        width *= 2
    return total


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Boolean mask of the ``n`` positions inside any span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0
