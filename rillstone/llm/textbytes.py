"""Whole texts as UTF-8 bytes in numpy: words, word hashes and shingle hashes, many documents at a time.

A batch is cut into slices of bounded size, so a text of any length needs a few bytes of memory per byte of the
slice and 8 bytes per word of the text. All hashes are fixed functions of the bytes: any task gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


#: Separators of words: space and \t to \r. A-Z is lower-cased, all other bytes stay.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, SLICE + 1)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), SLICE + 1)


def _slice_words(b: np.ndarray) -> np.ndarray:
    """Hashes of the words of one slice, in order; a word is not cut by the slice."""
    word = ~SPACE[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[_LOWER[b]] * _UP[: len(b)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def _long_word(b: np.ndarray) -> np.uint64:
    """A word that is longer than a slice: the hashes of its slices, hashed."""
    parts = [_slice_words(b[i : i + SLICE])[0] for i in range(0, len(b), SLICE)]
    h = np.uint64(len(parts))
    for p in parts:
        h = mix(np.array([h * _BASE + p]))[0]
    return h


def word_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, in order."""
    with np.errstate(over="ignore"):
        if len(b) <= SLICE:
            return _slice_words(b)
        out, at = [], 0
        while at < len(b):
            end = min(at + SLICE, len(b))
            if end < len(b):
                gaps = np.flatnonzero(SPACE[b[at:end]])
                if not len(gaps):  # a word of more than a slice
                    more = end
                    while more < len(b) and not (hit := np.flatnonzero(SPACE[b[more : more + SLICE]])).size:
                        more += SLICE
                    end = more + int(hit[0]) if more < len(b) else len(b)
                    out.append(np.array([_long_word(b[at:end])], np.uint64))
                    at = end
                    continue
                end = at + int(gaps[-1]) + 1
            out.append(_slice_words(b[at:end]))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, int, bytes]]:
    """``(first, last, bytes)``: texts joined by a line end, about ``size`` bytes at a time, a longer one alone."""
    at, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = as_bytes(t)
        if held and total + len(b) > size - len(held):
            yield at, i, b"\n".join(held)
            at, held, total = i, [], 0
        held.append(b)
        total += len(b)
    if held:
        yield at, len(texts), b"\n".join(held)


def batch_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts, in order: word hashes of the run, and the number of words of each of its texts."""
    for first, last, joined in slices(texts):
        b = np.frombuffer(joined, np.uint8)
        h = word_hashes(b)
        if last - first == 1:
            yield h, np.array([len(h)])
            continue
        word = ~SPACE[b]
        start = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
        size = np.array([len(as_bytes(t)) for t in texts[first:last]])
        ends = np.cumsum(size + 1)
        yield h, np.diff(np.searchsorted(start, ends), prepend=0)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole text if it has fewer; none without words."""
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        if n < 1:
            if not len(words):
                return np.empty(0, np.uint64)
            n, width = 1, len(words)
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = mix(out ^ words[i : i + n], width)
        return out
