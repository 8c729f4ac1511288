"""MD5 of many short texts at once, as numbers that order like its hexadecimal text."""

from __future__ import annotations

import math

import numpy as np

#: Texts hashed at once, so that the state stays in cache.
AT_ONCE = 8192
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(words: list) -> list[np.ndarray]:
    a, b, c, d = (np.full(len(words[0]), x, dtype=np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += _K[i]
        if words[g] is not None:
            f += words[g]
        turned = f << np.uint32(_TURN[i])
        f >>= np.uint32(32 - _TURN[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return [x + np.uint32(y) for x, y in zip((a, b, c, d), _START, strict=True)]


def md5_words(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the MD5 of every row of bytes, at most 55 in a row."""
    count, size = letters.shape
    if size > 55:
        raise ValueError("rows of more than 55 bytes")
    high, low = np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=np.uint64)
    used = size // 4 + 1
    for k in range(0, count, AT_ONCE):
        part = letters[k : k + AT_ONCE]
        message = np.zeros((len(part), 4 * used), dtype=np.uint8)
        message[:, :size] = part
        message[:, size] = 0x80
        words: list = [None] * 16
        words[:used] = np.ascontiguousarray(message.view("<u4").T)
        words[14] = np.full(len(part), 8 * size, dtype=np.uint32)
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in _block(words))
        high[k : k + AT_ONCE], low[k : k + AT_ONCE] = (a << np.uint64(32)) | b, (c << np.uint64(32)) | d
    return high, low
