"""Skip-grams with hierarchical softmax. Parts of the text are trained by a task each, in blocks of numbered words, and the
vectors of the parts are averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rillstone.functions.runtime import cut_lineage, small_batches

#: Numbers of neighbours that are multiplied at once; a run of neighbours is filled up to the next.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256])
#: Neighbours are at most so many places away, and not beyond a sentence of so many words.
WINDOW, SENTENCE = 5, 1000
#: A part is trained in about so many steps, or more, so that none has more words than BLOCK.
STEPS, BLOCK = 64, 100_000
RATE = 0.2


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node above each node and the side below it, 1 for the right one, in the Huffman tree of words that are numbered
    by falling counts. Words come before inner nodes, and the root is the last."""
    words = len(counts)
    above, side = np.zeros(2 * words - 1, np.int32), np.zeros(2 * words - 1, np.int8)
    # both queues rise: words from the rarest, and nodes as they are made
    leaves, made, i, j = counts.tolist(), [], words - 1, 0
    for node in range(words - 1):
        total = 0
        for k in (0, 1):
            if i >= 0 and (j >= node or leaves[i] <= made[j]):
                least, i, total = i, i - 1, total + leaves[i]
            else:
                least, j, total = words + j, j + 1, total + made[j]
            above[least], side[least] = words + node, k
        made.append(total)
    return above, side


class Tree:
    """Inner nodes above each word and the sides taken there, words of equal depth as rows of one table."""

    def __init__(self, above: np.ndarray, side: np.ndarray):
        self.words = words = (len(above) + 1) // 2
        self.depth = np.zeros(words, np.int8)
        at, left = np.arange(words), np.arange(words)
        while len(left := left[at[left] < 2 * words - 2]):
            self.depth[left] += 1
            at[left] = above[at[left]]
        # a word's row among those of its depth
        self.row, self.nodes, self.sides = np.zeros(words, np.int32), {}, {}
        for d in np.unique(self.depth).tolist():
            at = np.flatnonzero(self.depth == d)
            self.row[at] = np.arange(len(at))
            self.nodes[d], self.sides[d] = np.zeros((len(at), d), np.int32), np.zeros((len(at), d), np.int8)
            for k in range(d):
                self.nodes[d][:, k], self.sides[d][:, k] = above[at] - words, side[at]
                at = above[at]


def pairs(ids: np.ndarray, texts: np.ndarray, half: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct (word, neighbour) and its number, by word: neighbours are at most ``half`` places from the word, in
    the same text."""
    wide, found = ids.astype(np.int64), [np.zeros(0, np.int64)]
    for a in range(1, int(half.max(initial=0)) + 1):
        same = texts[a:] == texts[:-a]
        for word, other, near in ((wide[:-a], wide[a:], half[:-a]), (wide[a:], wide[:-a], half[a:])):
            keep = same & (near >= a)
            found.append(word[keep] * words + other[keep])
    keys = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    word, other = np.divmod(keys[first], words)
    return word, other, np.diff(first, append=len(keys)).astype(np.float32)


def _runs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of adjoining rows, whose sizes are given, cut into runs of at most the largest width. Runs come together with
    others of their width: the group of each, its rows, and whether a row is the run's own."""
    most = int(WIDTHS[-1])
    times = -(-size // most)
    group = np.repeat(np.arange(len(size)), times)
    skipped = (np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)) * most
    start, size = (np.cumsum(size) - size)[group] + skipped, np.minimum(size[group] - skipped, most)
    kind = np.searchsorted(WIDTHS, size)
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(len(WIDTHS) + 1))
    for width, a, b in zip(WIDTHS.tolist(), ends[:-1], ends[1:]):
        if a < b:
            those, step = order[a:b], np.arange(width)
            yield group[those], start[those][:, None] + step, step < size[those][:, None]


def _summed(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``at``, each once, and the sums of their rows."""
    order = np.argsort(at)
    ranked = at[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    sums = np.zeros((len(first), rows.shape[1]), np.float32)
    order = np.append(order, np.zeros(WIDTHS[-1], np.int64))
    for group, row, own in _runs(np.diff(first, append=len(at))):
        part = np.matmul(own.astype(np.float32)[:, None, :], rows.take(order.take(row), axis=0))[:, 0]
        if row.shape[1] == WIDTHS[-1]:  # there a group may have more runs than one
            np.add.at(sums, group, part)
        else:
            sums[group] += part
    return ranked[first], sums


class Trainer:
    """Vectors ``x`` of words and ``y`` of inner nodes. Each block is one step: gradients of all its pairs are summed, and
    each vector moves at a rate that falls with the gradients it has had."""

    def __init__(self, tree: Tree, size: int, seed: int, rate: float = RATE):
        self.tree, self.rate = tree, np.float32(rate)
        draws = np.random.default_rng(seed).random((tree.words, size), np.float32)
        self.x, self.y = (draws - np.float32(0.5)) / np.float32(size), np.zeros((tree.words - 1, size), np.float32)
        self.had_x, self.had_y = np.zeros((len(self.x), 1), np.float32), np.zeros((len(self.y), 1), np.float32)

    def _move(self, v: np.ndarray, had: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
        past = had[at] + np.einsum("ij,ij->i", gradient, gradient)[:, None] / np.float32(v.shape[1])
        had[at] = past
        v[at] += gradient * (self.rate / (np.sqrt(past) + np.float32(1e-6)))

    def step(self, word: np.ndarray, other: np.ndarray, n: np.ndarray) -> None:
        """``word`` in order, each with its distinct neighbours."""
        if not len(word) or self.tree.words < 2:
            return
        t, dims = self.tree, self.x.shape[1]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        other, n = np.append(other, np.zeros(WIDTHS[-1], np.int64)), np.append(n, np.zeros(WIDTHS[-1], np.float32))
        words, nodes, moves_x, moves_y = [], [], [], []
        for group, at, own in _runs(np.diff(first, append=len(word))):
            of = word[first[group]]
            depth = t.depth[of]
            for d in np.unique(depth).tolist():
                those = np.flatnonzero(depth == d)
                row, pair = t.row[of[those]], at[those]
                near, path = other.take(pair), t.nodes[d].take(row, axis=0)
                x, y = self.x.take(near, axis=0), self.y.take(path, axis=0)
                g = np.matmul(x, y.swapaxes(1, 2))
                np.clip(g, -30, 30, out=g)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                g -= t.sides[d].take(row, axis=0)[:, None, :]
                g *= (n.take(pair) * own[those])[:, :, None]
                words.append(near.ravel())
                nodes.append(path.ravel())
                moves_x.append(np.matmul(g, y).reshape(-1, dims))
                moves_y.append(np.matmul(g.swapaxes(1, 2), x).reshape(-1, dims))
        self._move(self.y, self.had_y, *_summed(np.concatenate(moves_y), np.concatenate(nodes)))
        self._move(self.x, self.had_x, *_summed(np.concatenate(moves_x), np.concatenate(words)))


def _lists(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Lengths and values of lists, of as many batches as hold ``least`` values; a null list is an empty one."""
    held, values = [], 0
    for batch in batches:
        held.append(batch.column(0))
        values += len(pc.list_flatten(held[-1]))
        if values >= least:
            yield _flat(held)
            held, values = [], 0
    if held:
        yield _flat(held)


def _flat(held: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    lists = pa.concat_arrays(held)
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and the numbers of their sentences: whole sentences, as many as a block of words holds."""
    ids, sentences, last = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
    for sizes, values in _lists(batches, block):
        nth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.concatenate([ids, values.to_numpy()])
        sentences = np.concatenate([sentences, last + np.cumsum(nth % SENTENCE == 0)])
        last = sentences[-1] if len(sentences) else last
        begin = 0
        while len(ids) - begin > block:
            end = int(np.searchsorted(sentences, sentences[begin + block]))
            yield ids[begin:end], sentences[begin:end]
            begin = end
        ids, sentences = ids[begin:], sentences[begin:]
    if len(ids):
        yield ids, sentences


def fit(df: DataFrame, words: str, size: int, min_count: int, seed: int, partitions: int) -> DataFrame:
    """``(word, vector)`` of words with ``min_count`` uses; ``words`` are lists. The words that are kept go through the driver,
    once, and to each task; a task that trains holds their vectors and inner nodes."""
    spark = small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in _lists(batches, 1 << 20):
            counted = pc.value_counts(values.drop_null())
            yield pa.record_batch([counted.field("values"), counted.field("counts")], ["word", "n"])

    listed = df.select(F.col(words).alias("_words"))
    used = listed.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = used.filter(F.col("n") >= min_count).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    if not kept.num_rows:
        raise ValueError(f"no word has {min_count} uses")
    counts = kept["n"].to_numpy()
    block = int(np.clip(counts.sum() // partitions // STEPS, SENTENCE, BLOCK))
    shared = spark.sparkContext.broadcast((kept["word"].combine_chunks(), *huffman(counts)))
    seed %= 1 << 63

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        # the words that are known are hashed anew for each call
        for sizes, values in _lists(batches, len(known)):
            ids = pc.index_in(values, value_set=known)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(ends, ids.drop_null())], ["ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, above, side = shared.value
        trainer = Trainer(Tree(above, side), size, seed)
        draws = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for ids, sentences in _blocks(batches, block):
            trainer.step(*pairs(ids, sentences, draws.integers(1, WINDOW + 1, len(ids)), len(known)))
        for a in range(0, len(known), 1 << 14):
            x = trainer.x[a : a + (1 << 14)]
            ends = np.arange(0, x.size + 1, size, dtype=np.int32)
            moved = pa.array(trainer.had_x[a : a + len(x), 0] > 0)
            yield pa.record_batch([known.slice(a, len(x)), moved, pa.ListArray.from_arrays(ends, x.ravel())], ["word", "moved", "vector"])

    numbered = listed.mapInArrow(number, "ids array<int>").repartition(partitions)
    parts = numbered.mapInArrow(train, "word string, moved boolean, vector array<float>")
    # a word that no part has moved keeps the vector that all parts began with
    each = [F.get("vector", F.lit(i)) for i in range(size)]
    mean = F.array(*(F.coalesce(F.avg(F.when(F.col("moved"), x)), F.avg(x)).cast("float").cast("double") for x in each))
    # a word has one row of each part, which sums made before the shuffle would only widen
    vectors = cut_lineage(parts.repartition("word").groupBy("word").agg(mean.alias("vector")))
    shared.unpersist()
    return vectors
