"""Vectorised text primitives for use inside tasks: word hashes and substring hashes over many texts at once.

Hashes are sums of table values times powers of an odd base, modulo 2**64, followed by a finaliser.
They depend on content only, so every task of every job gives equal content the same name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes A-Z become a-z, the others stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x).astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def name_pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name for each ordered pair of names."""
    return mix(mix(a + U64(0x632BE59BD9B4E019 + salt)) * U64(3) + b)


#: A random-looking odd value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64)) | U64(1)


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int, base: int = BASES[0]) -> np.ndarray:
    """base**0 .. base**(n-1), from a cache whose lengths are powers of two."""
    return _powers(1 << max(10, int(n).bit_length()), base)[:n]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array with one space after each text, and each text's start; the starts end with the length."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buffer, starts


def words(texts: list[bytes], lower: bool = False):
    """Every word of every text: (hash, start byte, end byte, words before each text); offsets are in ``joined(texts)``."""
    buffer, starts = joined(texts)
    return (*word_hashes(LOWER[buffer] if lower else buffer, starts), buffer, starts)


def word_hashes(buffer: np.ndarray, starts: np.ndarray):
    if not len(buffer):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U64), none, none, np.zeros(len(starts), dtype=np.int64)
    gap = SPACE[buffer]
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    of_text = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, dtype=U64), begin, end, of_text
    length = end - begin
    inside = np.flatnonzero(~gap)
    at = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    value = BYTE_VALUE[buffer[inside]] * powers(int(length.max()))[at]
    total = np.add.reduceat(value, np.cumsum(length) - length)
    return mix(total + length.astype(U64) * U64(BASES[1])), begin, end, of_text


class Spans:
    """Hashes of any spans of an array of 64-bit symbols: spans with equal symbols have equal hashes."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        self.down = powers(n + 1, pow(base, -1, 1 << 64))
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * powers(n + 1, base)[:n], out=self.sums[1:])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U64))


def doubles(symbols: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """The hash of the ``k`` symbols from each position on, ``k`` a power of two; the last ``k - 1`` positions have none."""
    out, width = symbols, 1
    power = base
    while width < k:
        out = out[:-width] * U64(power) + out[width:] if len(out) > width else out[:0]
        power = power * power % (1 << 64)
        width *= 2
    return mix(out)
