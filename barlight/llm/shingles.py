"""Hashes of words and of runs of words, for whole batches of texts at once (NumPy, inside tasks)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_POINTS = 0x110000
_LAST = 0x40000  # no letter or digit has a code point from here on


@lru_cache(1)
def word_table() -> np.ndarray:
    """Whether each code point belongs to a word: letters, digits and the underscore."""
    table = np.zeros(_POINTS, bool)
    for c in range(_LAST):
        table[c] = chr(c).isalnum()
    table[ord("_")] = True
    return table


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Each code point's lower case as one code point: the first of several."""
    table = np.arange(_POINTS, dtype=np.uint32)
    table[:_LAST] = [ord(chr(c).lower()[0]) for c in range(_LAST)]
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(1)
def powers(n: int = 4096) -> np.ndarray:
    out = np.ones(n, U)
    for i in range(1, n):
        out[i] = (int(out[i - 1]) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return out


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first character and end of each word of text, letters in lower case."""
    if text.isascii():
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    else:
        codes = lower_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]  # one for one, so places stay those of the text
    inside = word_table()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U), starts, ends
    kept = np.flatnonzero(inside)
    place = kept - np.repeat(starts, ends - starts)
    value = (codes[kept].astype(U) + U(1)) * powers()[place % 4096]
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return mix(np.add.reduceat(value, first) + (ends - starts).astype(U)), starts, ends


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; of all of them if there are fewer than n; none without words."""
    n = min(n, len(hashes))
    if n == 0:
        return np.zeros(0, U)
    total = np.zeros(len(hashes) - n + 1, U)
    for i in range(n):
        total = mix(total * U(0xD1342543DE82EF95) + hashes[i : i + len(total)])
    return total
