"""Passages of test items inside documents, found by Wu-Manber search for many strings at once.

Texts are reduced to their words with one space around each, so a window of words is a byte string and its occurrences
are those of whole words. The strings are cut into classes of similar length. In a class, every block of bytes in the
first ``m`` bytes of a string has a shift, the least distance from its end to the end of those bytes; a block that no
string has lets the search skip the most. Many places of a buffer are searched at the same time, each moves on by its
own shift. Where the shift is zero, the block's hash selects the strings that end their first ``m`` bytes with it, the
first bytes are compared, and then the string itself.

Strings come in groups of bounded size, one pass over the texts each; the number of groups follows from the items.

Defined cases: a null text has no words. An item without words has no window; items of the same id are one. An item
without ``item_id`` marks words but has no name: it is in ``n_hit`` and not in ``n_items``. Rows keep their ``doc_id``,
null or repeated; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.llm.blocks import written
from rillstone.llm.spans import LOWER, spans, table
from rillstone.llm.textbytes import as_bytes, mix, slices

#: Bytes of words: letters and digits, and all of other scripts.
INSIDE = table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
SPACE = 32
#: Bytes of strings in one group; a group is sent to all tasks.
PER_GROUP = 1 << 25
#: Bytes between two places of a buffer where a search begins.
LANE = 1 << 11
MOST_BLOCK = 8
_ODD = mix(np.arange(1, dtype=np.uint64), 31)[0] | np.uint64(1)
_NONE = np.empty(0, np.int64)


def reduced(texts: list[str | None], joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts that are joined by a byte each, in lower case, with one space before and after each word, and
    the number of words of each text."""
    b = np.frombuffer(joined + b"\n", np.uint8)
    word = INSIDE[b]
    start, _ = spans(word)
    counts = np.diff(np.searchsorted(start, np.cumsum([len(as_bytes(t)) + 1 for t in texts])), prepend=0)
    out = LOWER[b]
    out[~word] = SPACE
    after = np.append(False, word[:-1])
    return np.concatenate((np.array([SPACE], np.uint8), out[word | after])), counts


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; places after the end are zero."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    return np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))


class Searcher:
    """The tables of a class of strings, for a search of all of them at once."""

    def __init__(self, strings: list[bytes], names: np.ndarray):
        self.strings, self.names = strings, names
        m = self.m = min(map(len, strings))
        self.block = min(MOST_BLOCK, max(1, m // 2))
        self.skip = m - self.block
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        self.bits = int(np.clip((len(strings) * (self.skip + 1) * 16).bit_length(), 8, 22))
        heads = np.frombuffer(b"".join(x[:m] for x in strings), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << self.bits, self.skip + 1, np.int32)
        for j in range(self.skip + 1):  # the last blocks come last and have the least shift
            self.shift[self._hash(self._packed(heads[:, j : j + self.block]))] = self.skip - j
        last = self._hash(self._packed(heads[:, self.skip :]))
        order = np.argsort(last, kind="stable")
        self.bucket = order
        self.first = np.searchsorted(last[order], np.arange((1 << self.bits) + 1))
        self.head_mask = np.uint64((1 << (8 * min(m, 8))) - 1)
        self.head = self._packed(heads[:, :8])

    @staticmethod
    def _packed(rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        return wide.view("<u8").ravel()

    def _hash(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((block * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, eights: np.ndarray, n: int) -> np.ndarray:
        """Where a string may begin: the shift is zero there. All lanes of the buffer move at the same time."""
        at = np.arange(0, max(0, n - self.m + 1), LANE)
        end = np.minimum(at + LANE, n - self.m + 1)
        found = [np.empty(0, np.int64)]
        while len(at):
            move = self.shift[self._hash(eights[at + self.skip] & self.mask)]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            if (on := at < end).all():
                continue
            at, end = at[on], end[on]
        return np.concatenate(found)

    def find(self, b: np.ndarray, eights: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of every occurrence."""
        at = self.places(eights, len(b))
        h = self._hash(eights[at + self.skip] & self.mask)
        n = self.first[h + 1] - self.first[h]
        where = np.repeat(at, n)
        which = self.bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[h], n)]
        like = (eights[where] & self.head_mask) == self.head[which]
        where, which = where[like], which[like]
        same = [raw.startswith(self.strings[k], p) for p, k in zip(where.tolist(), which.tolist(), strict=True)]
        return where[same], self.names[which[same]]


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``string, words, item``: the distinct windows of items, one space before and after each word; null ids stay."""

    def run(batches):
        for rows in batches:
            out = []
            for item, text in zip(rows["item"], rows["text"], strict=True):
                b, _ = reduced([text], as_bytes(text))
                space = np.flatnonzero(b == SPACE)
                words, raw = len(space) - 1, b.tobytes()
                k = min(size, words)
                if k:
                    out += [(x, k, item) for x in {raw[space[i] : space[i + k] + 1] for i in range(words - k + 1)}]
            yield pd.DataFrame(out, columns=["string", "words", "item"])

    read = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "string binary, words int, item string").distinct()


class Patterns:
    """All strings of a group: one searcher for each class of lengths, words and items of each string."""

    def __init__(self, rows: pd.DataFrame):
        strings, number = {}, []
        for x in rows["string"]:
            number.append(strings.setdefault(bytes(x), len(strings)))
        each = list(strings)
        self.words = np.zeros(len(each), np.int64)
        self.words[number] = rows["words"].to_numpy()
        self.items: list[list[str]] = [[] for _ in each]
        for k, item in zip(number, rows["item"], strict=True):
            if item is not None:
                self.items[k].append(item)
        classes = np.array([len(x).bit_length() for x in each])
        self.searchers = [
            Searcher([each[k] for k in np.flatnonzero(classes == c)], np.flatnonzero(classes == c)) for c in np.unique(classes)
        ]

    def find(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eights, raw = _eights(b), b.tobytes()
        found = [s.find(b, eights, raw) for s in self.searchers] or [(np.empty(0, np.int64), np.empty(0, np.int64))]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


#: Words hit so far, as pairs of first and last, and the items found.
STATE = "n_words long, n_hit long, hits binary, items array<string>"


def _marked(texts: list[str | None], before: pd.DataFrame, patterns: Patterns) -> Iterator[pd.DataFrame]:
    """The state of runs of texts after one more group of strings."""
    for first, last, joined in slices(texts):
        b, counts = reduced(texts[first:last], joined)
        ends = np.cumsum(counts)
        begin = ends - counts
        where, which = patterns.find(b)
        word = np.searchsorted(np.flatnonzero(b == SPACE), where)
        text = np.searchsorted(ends, word, side="right")
        inside = text == np.searchsorted(ends, word + patterns.words[which] - 1, side="right")
        word, text, which = word[inside], text[inside], which[inside]
        total = int(ends[-1])
        change = np.bincount(word, minlength=total + 1) - np.bincount(word + patterns.words[which], minlength=total + 1)
        items = [set(x) for x in before["items"].iloc[first:last]]
        for t, k in set(zip(text.tolist(), which.tolist(), strict=True)):
            items[t].update(patterns.items[k])
        for t, held in enumerate(before["hits"].iloc[first:last]):
            old = np.frombuffer(held, np.int64).reshape(-1, 2) + begin[t]
            np.add.at(change, old[:, 0], 1)
            np.add.at(change, old[:, 1] + 1, -1)
        hit = np.cumsum(change)[:total] > 0
        sums = np.concatenate(([0], np.cumsum(hit)))
        runs = []
        for t in range(last - first):
            s, e = spans(hit[begin[t] : ends[t]]) if sums[ends[t]] > sums[begin[t]] else (_NONE, _NONE)
            runs.append(np.stack((s, e - 1), axis=1).astype(np.int64).tobytes())
        yield pd.DataFrame({
            "n_words": counts, "n_hit": sums[ends] - sums[begin], "hits": runs, "items": [sorted(x) for x in items],
        })


def marked(docs: DataFrame, items: DataFrame, size: int = 10, per_group: int = PER_GROUP) -> DataFrame:
    """``doc_id, n_words, n_hit, hits, items`` of every row: hits has the first and last number of each run of hit
    words as pairs of 64-bit integers, items the sorted ids of the items found."""
    windows = written(item_windows(items, size), "windows")
    bytes_of = windows.agg(F.sum(F.octet_length("string") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    groups = max(1, -(-int(bytes_of) // per_group))
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items")
    )
    for g in range(groups):
        own = windows.filter(F.pmod(F.xxhash64("string"), F.lit(groups)) == g).toArrow().to_pandas()
        held = docs.sparkSession.sparkContext.broadcast(Patterns(own))

        def run(batches, held=held, more=g + 1 < groups):
            for rows in batches:
                at = 0
                for frame in _marked(rows["text"].tolist(), rows, held.value):
                    frame.insert(0, "doc_id", rows["doc_id"].iloc[at : at + len(frame)].to_numpy())
                    frame.insert(1, "text", rows["text"].iloc[at : at + len(frame)].to_numpy())
                    at += len(frame)
                    yield frame if more else frame.drop(columns="text")

        text = "text string, " if g + 1 < groups else ""
        state = state.select("doc_id", "text", "hits", "items").mapInPandas(run, f"doc_id {kind}, {text}{STATE}")
        if text:
            state = written(state, "marked")
    return state


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, per_group: int = PER_GROUP) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs(doc_id, text)`` against
    ``items(item_id, text)``."""
    return marked(docs, items, size, per_group).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
