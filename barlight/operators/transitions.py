"""Rules that depend on the order of a key's rows, as transitions that compose: a key's rows are cut into spans, many tasks.

A span that does not begin its key cannot know the state it starts from, so it works out where every state would lead. One row a span
is left, and those are followed in order from the known first state.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa

# ---- reinforcement: quality and the session's sum in thousandths ----


def moved(state: tuple[int, int, int], d: int, cap: int) -> tuple[int, int, int]:
    """(quality, sum, applied) after one event, in thousandths. Beyond the cap of the session's sum it is skipped; quality is rounded to hundredths, half to even."""
    q, s, n = state
    if abs(s + d) > cap:
        return state
    low, rest = divmod(max(0, min(1000, q + d)), 10)
    return 10 * (low + (rest > 5 or (rest == 5 and low % 2 == 1))), s + d, n + 1


class Known:
    """A span from a known state."""

    def __init__(self, state: tuple[int, int, int], cap: int) -> None:
        self.state, self.cap = state, cap

    def apply(self, deltas: np.ndarray, fresh: np.ndarray) -> None:
        """fresh: whether a session begins with the event."""
        for d, new in zip(deltas.tolist(), fresh.tolist()):
            q, s, n = self.state
            self.state = moved((q, 0 if new else s, n), d, self.cap)


class Every:
    """A span from every state: quality in whole hundredths, sums that the deltas' common divisor reaches from 0.

    States that meet stay together, so after some events few different ones are left to move."""

    def __init__(self, cap: int, step: int) -> None:
        self.cap, self.step, self.reach = cap, step, cap // step
        q, s = np.meshgrid(np.arange(0, 1001, 10), step * np.arange(-self.reach, self.reach + 1))
        self.q, self.s, self.n = q.ravel(), s.ravel(), np.zeros(q.size, np.int64)  # of each different state
        self.at, self.counted = np.arange(q.size), np.zeros(q.size, np.int64)  # of each start: its state, and what was applied before that state was met

    def place(self, state: tuple[int, int, int]) -> int:
        q, s, _ = state
        return (s // self.step + self.reach) * 101 + q // 10

    def apply(self, deltas: np.ndarray, fresh: np.ndarray) -> None:
        for i in range(0, len(deltas), 32):
            for d, new in zip(deltas[i : i + 32].tolist(), fresh[i : i + 32].tolist()):
                self.s = np.zeros_like(self.s) if new else self.s
                ok = np.abs(self.s + d) <= self.cap
                low, rest = np.divmod(np.clip(self.q + d, 0, 1000), 10)
                self.q = np.where(ok, 10 * (low + ((rest > 5) | (rest == 5) & (low % 2 == 1))), self.q)
                self.s = np.where(ok, self.s + d, self.s)
                self.n += ok
            self.counted += self.n[self.at]
            _, first, to = np.unique(self.s * 2048 + self.q, return_index=True, return_inverse=True)
            self.q, self.s, self.n, self.at = self.q[first], self.s[first], np.zeros(len(first), np.int64), to[self.at]

    def table(self) -> np.ndarray:
        """Rows of quality, sum, applied: one for each start."""
        return np.stack([self.q[self.at], self.s[self.at], self.counted], 1).astype(np.int64)


def step_of(deltas: list[int]) -> int:
    return gcd(*map(abs, deltas))


# ---- writes: the earliest time at which the next one is accepted ----


def chain_ends(ts: np.ndarray, window: int) -> np.ndarray:
    """For each of the sorted different times the last one that is accepted if that one is: successors, doubled until all stand still."""
    last = np.arange(len(ts))
    to = np.searchsorted(ts, ts + window)
    to = np.where(to == len(ts), last, to)
    while not (to == (further := to[to])).all():
        to = further
    return ts[to]


def accepted_from(ts: np.ndarray, window: int, free_at: int) -> np.ndarray:
    """The sorted different times that are accepted if the first one not before free_at is."""
    out, i = [], int(np.searchsorted(ts, free_at))
    while i < len(ts):
        out.append(i)
        i = int(np.searchsorted(ts, ts[i] + window))
    return ts[out]


def release(ts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The span's step function: a write may be accepted from `upto` on or earlier → from the time `then` on. Later starts than the last `upto` pass unchanged."""
    then = chain_ends(ts, window) + window
    last = np.concatenate([then[1:] != then[:-1], [True]])
    return ts[last], then[last]


# ---- runs of a key in sorted batches ----


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, whether it is new, rows of it) of batches that are sorted by their keys; a run that goes over batches comes in parts."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            yield key, key != before, batch.slice(a, b - a)
            before = key
