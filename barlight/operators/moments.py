"""Centred moments that merge: count, mean and sums of the second to fourth powers of what is left of it.

Nothing is ever subtracted from a running sum, so a value that has left a window leaves no digits behind, and values that are
all equal have a second moment of exactly 0. Works on numpy arrays and, up to the second moment, on Spark columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Moments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of two sets taken together (counts above 0)."""
    (na, ma, a2, a3, a4), (nb, mb, b2, b3, b4) = a, b
    n, d = na + nb, mb - ma
    share = na * nb / n
    m2 = a2 + b2 + d * d * share
    m3 = a3 + b3 + d**3 * share * (na - nb) / n + 3 * d * (na * b2 - nb * a2) / n
    m4 = a4 + b4 + d**4 * share * (na * na - na * nb + nb * nb) / (n * n) + 6 * d * d * (na * na * b2 + nb * nb * a2) / (n * n) + 4 * d * (na * b3 - nb * a3) / n
    return n, ma + d * nb / n, m2, m3, m4


def running(blocks: np.ndarray) -> Moments:
    """blocks: rows of values. Moments of each row's values up to each place, by doubling: spans of 1, 2, 4, … places are merged."""
    width = blocks.shape[1]
    n, zero = np.ones(width), np.zeros_like(blocks)
    out = (n, blocks, zero, zero, zero)
    span = 1
    while span < width:
        head = tuple(x[..., :span] for x in out)
        out = tuple(np.concatenate(x, -1) for x in zip(head, merged(tuple(x[..., :-span] for x in out), tuple(x[..., span:] for x in out))))
        span *= 2
    return out


def windows(x: np.ndarray, length: int) -> Moments:
    """Moments of the `length` values that end at each place from length - 1 on: a suffix of one block of that length and a prefix of the next."""
    blocks = np.concatenate([x, np.full(-len(x) % length, x[-1])]).reshape(-1, length)
    flat = lambda m: tuple(np.broadcast_to(a, blocks.shape).ravel() for a in m)
    prefix = flat(running(blocks))
    suffix = flat(tuple(a[..., ::-1] for a in running(blocks[:, ::-1])))
    end = np.arange(length - 1, len(x))
    whole = end % length == length - 1
    start = np.where(whole, 0, end - length + 1)
    both = merged(tuple(a[start] for a in suffix), tuple(a[end] for a in prefix))
    return tuple(np.where(whole, p[end], b) for p, b in zip(prefix, both))


def sums(x: np.ndarray, length: int) -> np.ndarray:
    """Sums of at most `length` values that end at each place, from sums within blocks: each value is in one prefix and one suffix of them."""
    blocks = np.concatenate([x, np.zeros(-len(x) % length, x.dtype)]).reshape(-1, length)
    prefix, suffix = np.cumsum(blocks, 1).ravel(), np.cumsum(blocks[:, ::-1], 1)[:, ::-1].ravel()
    end = np.arange(len(x))
    reaches_back = (end % length != length - 1) & (end >= length)
    return prefix[end] + np.where(reaches_back, suffix[np.maximum(end - length + 1, 0)], 0)


def shape(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Population skewness, excess kurtosis, and whether there are any: values that differ by rounding alone have none."""
    n, mean, m2, m3, m4 = m
    v = m2 / n
    varies = v > (np.finfo(float).eps * mean) ** 2
    v = np.where(varies, v, 1.0)
    return m3 / n / v**1.5, m4 / n / (v * v) - 3, varies


def pooled(n: Column, mean: Column, m2: Column) -> tuple[Column, Column, Column]:
    """Aggregates of n, mean and m2 over summaries (rows with n = 0 count for nothing), in that order: the second moment is that within plus that between them."""
    total = F.sum(n)
    centre = F.try_divide(F.sum(n * mean), total)
    return total, centre, F.sum(m2)
