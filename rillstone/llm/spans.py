"""Words as spans of a byte buffer: where they are, their 64-bit hashes, and how often each stands in a batch.

A buffer is a run of texts joined by line ends, so a table of separators that has the line end keeps texts apart.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from rillstone.llm.textbytes import _DOWN, _UP, SLICE, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(members: bytes | range | list[int]) -> np.ndarray:
    """Which byte values are members."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


@lru_cache(maxsize=4)
def _byte_hashes(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 1000 + seed)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[::2], edge[1::2]


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order. A buffer of any length is taken a slice at a time, a span
    that is longer than a slice is hashed as a whole."""
    out = np.empty(len(start), np.uint64)
    values, at = _byte_hashes(seed), 0
    with np.errstate(over="ignore"):
        while at < len(start):
            first = start[at]
            last = len(start) if len(b) - first <= SLICE else int(np.searchsorted(end, first + SLICE, side="right"))
            if last == at:
                digest = hashlib.blake2b(b[first : end[at]].tobytes(), digest_size=8, salt=str(seed).encode()).digest()
                out[at], at = int.from_bytes(digest, "little"), at + 1
                continue
            part = b[first : end[last - 1]]
            total = np.concatenate(([np.uint64(0)], np.cumsum(values[part] * _UP[: len(part)], dtype=np.uint64)))
            s, e = start[at:last] - first, end[at:last] - first
            out[at:last] = mix((total[e] - total[s]) * _DOWN[s] + (e - s).astype(np.uint64))
            at = last
    return out


def runs_of(order_by: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of ``keys`` counted: the position of one row of each run and the length of the run, in the order of
    ``order_by``, a hash of the keys. Different rows are never counted as one, even if their hashes are equal."""
    if not len(order_by):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(order_by, kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys or (order_by,):
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


class Lookup:
    """Positions of 64-bit hashes in a sorted list of distinct ones; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(max(1, 64 - max(1, len(keys)).bit_length()))
        top = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        bounds = (top[:-1] << self.shift).astype(np.uint64)
        self.start = np.append(np.searchsorted(keys, bounds), len(keys)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        top = (h >> self.shift).astype(np.int64)
        at, last = self.start[top], self.start[top + 1]
        todo = np.flatnonzero(at < last)
        at, last, want = at[todo], last[todo], h[todo]
        while len(todo):
            hit = self.keys[at] == want
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < last)
            todo, at, last, want = todo[more], at[more] + 1, last[more], want[more]
        return out
