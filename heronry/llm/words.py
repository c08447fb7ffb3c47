"""Word hashes of many texts at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Byte tables: white space U+0009 to U+000D and U+0020 part words, A-Z become a-z; LETTERS also makes
#: every other ASCII character than letters and digits part words.
PLAIN = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of BASE and of its inverse, modulo 2^64."""
    global _power, _inverse
    if len(_power) < n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _power, _inverse = out
    return _power[:n], _inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


#: Bytes that are hashed at once: some 50 bytes of memory a byte.
BLOCK = 1 << 19


def word_hashes(texts: list[bytes], table: bytes = PLAIN, lengths: bool = False) -> tuple[np.ndarray, ...]:
    """(text index, hash) of every word of the texts, in order. Long data goes in blocks that end at a space.

    ``lengths`` adds each word's first byte in its text and its length in code points."""
    data = b" " + b" ".join(texts).translate(table) + b" "
    starts, hashes, chars, lo, last = [], [], [], 0, len(data) - 1
    while lo < last:
        hi = last
        if last - lo > BLOCK:
            hi = data.rfind(b" ", lo + 1, lo + BLOCK)
            if hi < 0:
                hi = data.find(b" ", lo + BLOCK)
        x = np.frombuffer(data, np.uint8, hi + 1 - lo, lo)
        gap = x == 32
        edge = np.nonzero(gap[1:] != gap[:-1])[0] + 1
        start, end = edge[0::2], edge[1::2]
        power, inverse = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        starts.append(start + lo)
        if lengths:
            points = np.zeros(len(x) + 1, np.int64)
            np.cumsum((x & 0xC0) != 0x80, out=points[1:])
            chars.append(points[end] - points[start])
        hashes.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        lo = hi
    ends = 1 + np.cumsum([len(t) + 1 for t in texts])
    start = np.concatenate(starts)
    index = np.searchsorted(ends, start, "right")
    if not lengths:
        return index, np.concatenate(hashes)
    first = np.concatenate([[1], ends[:-1]])  # of each text in the joined bytes
    return index, np.concatenate(hashes), start - first[index], np.concatenate(chars)
