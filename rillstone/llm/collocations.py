"""Phrases whose words stand together more often than apart, counted by double-array tries.

The texts are read once, into blocks that have the distinct words and the place of each word among them; everything
after works on these. Candidates grow by one word at a time and only where all shorter parts are frequent (Apriori): a
bitmap of fixed size has every frequent phrase of the level before, tasks send the windows whose two parts are in it, each
once a block with its count up to the threshold, and windows whose sums reach the threshold are candidates. They are cut
into tries of a bounded number of phrases. A trie is a double array over numbered words, each taken in two steps, and is
broadcast; a task moves the states of all positions of a block at once, word by word, counts accepting states, and the
counts of all tasks are summed.

Words are known by 64-bit hashes of language and word. A second hash of each shows whether two words share one; where
that could matter, another seed is taken.

Defined cases: a null text has no words; a null language is ``und``. ``doc_id`` and other columns are not read.
Repeated rows count as often as they stand. Without phrases there are no rows.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rillstone.functions.runtime import settled, written
from rillstone.llm.spans import LOWER, Lookup, runs_of, span_hashes, spans, table
from rillstone.llm.textbytes import as_bytes, mix, slices

BREAK = table(b".,;:!?\n\x0b\x0c\r")
APART = BREAK | table(b" \t")
#: Bits of the bitmap of frequent phrases. A full one lets more windows through, never fewer.
BITS = 1 << 26
CHUNK = 1 << 13
#: Words in one block of the texts; a longer text is a block by itself.
BLOCK = 1 << 18
#: Words that a task remembers to have spelt.
TOLD = 1 << 20
#: Phrases that a task holds before it counts or sends them, and windows it sends at once.
HELD = 1 << 19
SENT = 1 << 17
#: Phrases in one trie. Each trie takes one pass over the texts.
PER_TRIE = 1 << 20


def _of_name(name: str, seed: int) -> int:
    b = np.frombuffer(as_bytes(f"{name} "), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]), seed)[0])


def _words(texts: list[str | None], langs: list[str], seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``bytes, start, end, key, other, lang, joint`` for runs of texts: a key is a hash of language and word, other a second
    one, joint says whether the next word stands in the same piece."""
    names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
    seeds = np.array([_of_name(x, seed) for x in names.tolist()], np.uint64)
    values = mix(np.arange(256, dtype=np.uint64), 2000 + seed)
    for first, last, joined in slices(texts):
        b = LOWER[np.frombuffer(joined, np.uint8)]
        start, end = spans(~APART[b])
        if not len(start):
            continue
        sizes = np.array([len(as_bytes(t)) + 1 for t in texts[first:last]])
        lang = code[np.searchsorted(np.cumsum(sizes), start, side="right") + first]
        joint = np.ones(len(start), bool)
        after = np.searchsorted(start, np.flatnonzero(BREAK[b]))
        joint[after[after > 0] - 1] = False
        joint[-1] = False
        total = np.concatenate(([np.uint64(0)], np.cumsum(values[b], dtype=np.uint64)))
        key = mix(span_hashes(b, start, end, seed) ^ seeds[lang])
        yield b, start, end, key, total[end] - total[start] + seeds[lang], names[lang], joint


def _spelt(held: list[tuple], at: np.ndarray) -> pa.Array:
    """The words at some positions of joined runs of texts."""
    cut = np.cumsum([0] + [len(h[0]) for h in held])[:-1]
    start, end = (np.concatenate([h[i] + c for h, c in zip(held, cut, strict=True)])[at] for i in (1, 2))
    ends = np.cumsum(end - start)
    b = np.concatenate([h[0] for h in held])[np.arange(ends[-1] if len(at) else 0) + np.repeat(end - ends, end - start)]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(b))


#: A block of words, or a word of a block.
KEYED = "keys binary, places binary, joint binary, key long, lang string, word string, n long, other long, shared boolean"
_FIELDS = pa.schema([("keys", pa.binary()), ("places", pa.binary()), ("joint", pa.binary()), ("key", pa.int64()), ("lang", pa.string()),
    ("word", pa.string()), ("n", pa.int64()), ("other", pa.int64()), ("shared", pa.bool_())])


def _batch(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FIELDS], schema=_FIELDS)


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """The texts read once, as rows of two kinds. ``keys, places, joint``: a block of words in order, as its distinct
    keys, the place of each word among them, and a bit for words whose next stands in the same piece. ``key, lang, word,
    n, other, shared``: a word of a block, with its count and second hash, and whether the block has two of these under the
    key. A task spells a word the first time, and again when it has met very many others."""

    def block(held: list[tuple], told: np.ndarray) -> Generator[pa.RecordBatch, None, np.ndarray]:
        key = np.concatenate([h[3] for h in held])
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(key), np.uint32)
        place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        key, at, n = key[first], order[first], np.diff(np.append(first, len(key)))
        joint = np.packbits(np.concatenate([h[6] for h in held]))
        yield _batch(keys=[key.tobytes()], places=[place.tobytes()], joint=[joint.tobytes()])
        other = np.concatenate([h[4] for h in held])[order]
        shared = np.logical_or.reduceat(other != np.repeat(other[first], n), first)
        lang = np.concatenate([h[5] for h in held])[at]
        fresh = ~np.isin(key, told, assume_unique=True)
        for rows, word in ((fresh, {"word": _spelt(held, at[fresh])}), (~fresh, {})):
            yield _batch(key=key[rows].view(np.int64), lang=lang[rows], n=n[rows], other=other[first[rows]].view(np.int64), shared=shared[rows], **word)
        return np.union1d(told, key) if len(told) < TOLD else key

    def run(batches):
        told, held, total = np.empty(0, np.uint64), [], 0
        for rows in batches:
            for h in _words(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), seed):
                held.append(h)
                total += len(h[1])
                if total >= BLOCK:
                    told = yield from block(held, told)
                    held, total = [], 0
        if held:
            yield from block(held, told)

    return written(docs.select("text", "lang").mapInArrow(run, KEYED), "keyed")


def _blocks(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``keys, places, joint`` of the blocks in a batch."""
    for keys, places, joint in zip(*(rows.column(c) for c in ("keys", "places", "joint")), strict=True):
        place = np.frombuffer(places.as_buffer(), np.uint32)
        yield np.frombuffer(keys.as_buffer(), np.uint64), place, np.unpackbits(np.frombuffer(joint.as_buffer(), np.uint8), count=len(place)).astype(bool)


def blocks(texts: DataFrame) -> DataFrame:
    return texts.filter(F.col("keys").isNotNull()).select("keys", "places", "joint")


def count_words(texts: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``key, code, n, shared`` of all words, and ``lang, code, size`` of all languages. Words are shared that have one key
    and different second hashes."""
    words = texts.filter(F.col("key").isNotNull()).withColumn("code", F.xxhash64(F.lit(seed), "lang"))
    langs = words.groupBy("lang", "code").agg(F.sum("n").alias("size"))
    return words.groupBy("key").agg(
        F.max("code").alias("code"), F.sum("n").alias("n"), ((F.min("other") != F.max("other")) | F.max("shared")).alias("shared")
    ), langs


def _mark(keys: list[np.ndarray]) -> np.ndarray:
    """One hash for each window, from the keys of its words."""
    out = np.full(len(keys[0]), len(keys), np.uint64)
    for i, k in enumerate(keys):
        out = mix(out ^ k, i + 21)
    return out


def bitmap(phrases: DataFrame, words: int) -> np.ndarray:
    """A bit for every phrase of ``phrases(k0, k1, ...)``. Tasks send the chunks they have bits in; the driver gets the
    bitmap, whose size is fixed."""
    names = [f"k{i}" for i in range(words)]

    def bits(batches):
        held = np.zeros(BITS // 8, np.uint8)
        for rows in batches:
            at = _mark([rows[c].to_numpy().view(np.uint64) for c in names]) % np.uint64(BITS)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        for i, part in enumerate(held.reshape(-1, CHUNK)):
            if part.any():
                yield pd.DataFrame({"chunk": [i], "bits": [part.tobytes()]})

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1), axis=0)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "bits": [joined.tobytes()]})

    schema = "chunk int, bits binary"
    out = np.zeros((BITS // 8 // CHUNK, CHUNK), np.uint8)
    for r in phrases.select(*names).mapInPandas(bits, schema).groupBy("chunk").applyInPandas(either, schema).toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _in(held: np.ndarray, mark: np.ndarray) -> np.ndarray:
    at = mark % np.uint64(BITS)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _windows(places: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct windows of a block, whose words are places below ``size``, and how often each stands there."""
    bits = max(1, (size - 1).bit_length())
    if bits * len(places) > 64:
        at, n = runs_of(_mark([p.astype(np.uint64) for p in places]), *places)
        return [p[at] for p in places], n
    packed = np.zeros(len(places[0]), np.uint64)
    for p in places:
        packed = (packed << np.uint64(bits)) | p
    packed.sort()
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.empty(0, np.int64)
    n, packed = np.diff(np.append(first, len(packed))), packed[first]
    last = np.uint64((1 << bits) - 1)
    return [(packed >> np.uint64(bits * i)) & last for i in reversed(range(len(places)))], n


def candidates(texts: DataFrame, shorter: DataFrame, words: int, least: int) -> DataFrame:
    """``k0, k1, ...``: all phrases of so many words that stand ``least`` times, from blocks whose windows have both
    their parts in ``shorter``."""
    names = [f"k{i}" for i in range(words)]
    held = texts.sparkSession.sparkContext.broadcast(bitmap(shorter, words - 1))

    def run(batches):
        for rows in batches:
            for keys, place, joint in _blocks(rows):
                n = len(place) - words + 1
                if n < 1:
                    continue
                if words == 2:
                    live = _in(held.value, _mark([keys]))[place]
                else:
                    key = keys[place]
                    live = _in(held.value, _mark([key[i : i + n + 1] for i in range(words - 1)]))
                ok = live[:n] & live[1 : n + 1]
                for i in range(words - 1):
                    ok &= joint[i : i + n]
                at = np.flatnonzero(ok)
                found, n = _windows([place[at + i] for i in range(words)], len(keys))
                n = np.minimum(n, least)
                for i in range(0, len(n), SENT):
                    columns = [keys[f[i : i + SENT]].view(np.int64) for f in found] + [n[i : i + SENT].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "n"])

    sums = blocks(texts).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    out = settled(sums.filter(F.col("n") >= least).select(*names), f"phrases{words}")
    held.unpersist()
    return out


class Trie:
    """A double array over phrases of numbered words. The state of a first word is its number; from then on a word is
    two steps, by the high and the low digit of its number. ``check`` names the state that a slot belongs to."""

    def __init__(self, phrases: list[np.ndarray]):
        """``phrases`` has one array for each length, a column for each word."""
        self.keys = np.unique(np.concatenate([p.ravel() for p in phrases]))
        v = len(self.keys)
        self.digit = max(1, (max(1, v - 1).bit_length() + 1) // 2)
        self.base = np.zeros(v, np.int32)
        self.check = np.full(v, -1, np.int32)
        self.out = np.full(v, -1, np.int32)
        self.longest = max(p.shape[1] for p in phrases)
        self.low = v
        numbered = 0
        held = [np.searchsorted(self.keys, p) for p in phrases]
        state = [p[:, 0].astype(np.int64) for p in held]
        for depth in range(1, self.longest):
            for high in (True, False):
                at = [i for i, p in enumerate(held) if p.shape[1] > depth]
                symbol = [p[:, depth] >> self.digit if high else p[:, depth] & ((1 << self.digit) - 1) for p in (held[i] for i in at)]
                pairs = np.concatenate([state[i] << self.digit | s for i, s in zip(at, symbol, strict=True)])
                each, back = np.unique(pairs, return_inverse=True)
                slot = self._place(each >> self.digit, each & ((1 << self.digit) - 1))[back]
                cut = np.cumsum([len(state[i]) for i in at])[:-1]
                for i, s in zip(at, np.split(slot, cut), strict=True):
                    state[i] = s
            for i, p in enumerate(held):
                if p.shape[1] == depth + 1:
                    self.out[state[i]] = np.arange(numbered, numbered + len(p))
                    numbered += len(p)
        self.size = numbered
        end = int(np.flatnonzero(self.check >= 0).max(initial=v)) + (2 << self.digit)
        self.base, self.check, self.out = (x[:end].copy() for x in (self.base, self.check, self.out))
        del self.low

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))
            self.out = np.append(self.out, np.full(more, -1, np.int32))

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Slots for the children of states, which come sorted by parent; those with many children first."""
        span = 1 << self.digit
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        n = np.diff(np.append(first, len(parent)))
        slot = np.empty(len(parent), np.int64)
        floor, was = self.low, 0
        for k in np.argsort(-n, kind="stable")[: int((n > 1).sum())].tolist():
            i, m = int(first[k]), int(n[k])
            c = symbol[i : i + m]
            if m * 2 <= was or not was:  # smaller sets may fit into holes
                floor, was = self.low, m
            rest = c - c[0]
            while True:
                self._grow(floor + 256 + 2 * span)
                free = np.flatnonzero(self.check[floor : floor + 256] < 0) + floor
                fits = (self.check[free[:, None] + rest[:16]] < 0).all(axis=1) if len(free) else np.empty(0, bool)
                free = free[fits & (free - c[0] >= 0)]
                at = next((int(f) for f in free if m <= 16 or (self.check[f + rest] < 0).all()), None)
                if at is not None:
                    break
                floor += 256
            slot[i : i + m] = at + rest
            self.check[at + rest] = parent[i]
            self.base[parent[i]] = at - c[0]
        one = first[n == 1]
        if len(one):
            self._grow(self.low + span + len(one) + int((self.check[self.low :] >= 0).sum()) + span)
            free = np.flatnonzero(self.check[self.low + span :] < 0)[: len(one)] + self.low + span
            slot[one] = free
            self.check[free] = parent[one]
            self.base[parent[one]] = free - symbol[one]
        self._grow(int(slot.max()) + 2 * span if len(slot) else 0)
        return slot

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word; -1 where there is none."""
        for symbol in (word >> self.digit, word & ((1 << self.digit) - 1)):
            to = self.base[state] + symbol
            state = np.where((state >= 0) & (self.check[to] == state), to, -1)
        return state

    def find(self, number: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """The phrases in a run of numbered words, -1 for words of no phrase, each as often as it stands there."""
        found = [np.empty(0, np.int32)]
        at = np.flatnonzero(number >= 0)
        state = number[at].astype(np.int64)
        for depth in range(1, self.longest):
            ok = at + depth < len(number)
            at, state = at[ok], state[ok]
            ok = joint[at + depth - 1] & (number[at + depth] >= 0)
            at, state = at[ok], state[ok]
            state = self.step(state, number[at + depth].astype(np.int64))
            at, state = at[state >= 0], state[state >= 0]
            hit = self.out[state]
            found.append(hit[hit >= 0])
        return np.concatenate(found)


def count_phrases(texts: DataFrame, levels: list[DataFrame], per_trie: int = PER_TRIE) -> DataFrame:
    """``keys, a`` for every phrase of ``levels``. Phrases that begin with the same two words are in one trie; the number
    of tries follows from the number of phrases."""
    spark = texts.sparkSession
    each = None
    for i, level in enumerate(levels):
        part = level.select(F.lit(i + 2).alias("words"), F.array(*(f"k{j}" for j in range(i + 2))).alias("keys"))
        each = part if each is None else each.unionByName(part)
    phrases = written(each.withColumn("id", F.monotonically_increasing_id()), "phrases")
    rounds = max(1, -(-phrases.count() // per_trie))
    shard = F.pmod(F.xxhash64(F.slice("keys", 1, 2)), F.lit(rounds))
    counts = spark.createDataFrame([], "id long, a long")
    for k in range(rounds):
        arrays, ids = [], []
        for i in range(len(levels)):
            own = phrases.filter(F.col("words") == i + 2).filter(shard == k).select("id", *(F.get("keys", F.lit(j)).alias(f"k{j}") for j in range(i + 2))).toArrow()
            if own.num_rows:
                arrays.append(np.stack([own.column(f"k{j}").to_numpy().view(np.uint64) for j in range(i + 2)], axis=1))
                ids.append(own.column("id").to_numpy())
        if not arrays:
            continue
        trie = spark.sparkContext.broadcast((Trie(arrays), np.concatenate(ids)))
        del arrays, ids

        def run(batches, trie=trie):
            t, ids = trie.value
            lookup = Lookup(t.keys)
            total, held, waiting = np.zeros(t.size, np.int64), [], 0
            for rows in batches:
                for keys, place, joint in _blocks(rows):
                    held.append(t.find(lookup.find(keys)[place], joint))
                    waiting += len(held[-1])
                    if waiting > 2 * HELD:
                        total += np.bincount(np.concatenate(held), minlength=t.size)
                        held, waiting = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=t.size)
            at = np.flatnonzero(total)
            for i in range(0, len(at), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[i : i + HELD]]), pa.array(total[at[i : i + HELD]])], names=["id", "a"])

        counted = settled(blocks(texts).mapInArrow(run, "id long, a long").groupBy("id").agg(F.sum("a").alias("a")), "counted")
        counts = counts.unionByName(counted)
        trie.unpersist()
    return phrases.join(counts, "id").select("keys", "a")


#: ``floor(1000000 * a * a / (l * r))``, exact.
SCORE = """(cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0)))
    div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"""


def collocations(docs: DataFrame, words: int = 3, least: int = 10, within: int = 50, top: int = 2000, per_trie: int = PER_TRIE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language of ``docs(text, lang)``, of two to
    ``words`` words that stand ``least`` times; a phrase goes if a longer one around it has ``within`` per cent of its
    occurrences."""
    read = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    seed = 0
    while True:
        texts = keyed(read, seed)
        vocabulary, langs = count_words(texts, seed)
        vocabulary = settled(vocabulary.filter(F.col("n") >= least), "words")
        langs = written(langs, "langs")
        if vocabulary.filter("shared").isEmpty() and langs.groupBy("code").count().filter("count > 1").isEmpty():
            break
        seed += 1
    frequent = vocabulary.select("key", "code", F.col("n").alias("f"))
    levels, shorter = [], frequent.select(F.col("key").alias("k0"))
    for length in range(2, words + 1):
        shorter = candidates(texts, shorter, length, least)
        levels.append(shorter)
    phrases = written(count_phrases(texts, levels, per_trie), "counts")
    known = phrases.select("keys", F.col("a").alias("f")).unionByName(frequent.select(F.array("key").alias("keys"), "f"))
    # the lowest cut of each phrase
    cuts = phrases.select("keys", "a", F.explode(F.sequence(F.lit(1), F.size("keys") - 1)).alias("cut")).select(
        "keys", "a", "cut", F.slice("keys", F.lit(1), F.col("cut")).alias("_left"),
        F.slice("keys", F.col("cut") + 1, F.size("keys") - F.col("cut")).alias("_right"),
    )
    cuts = cuts.join(known.select(F.col("keys").alias("_left"), F.col("f").alias("l")), "_left")
    cuts = cuts.join(known.select(F.col("keys").alias("_right"), F.col("f").alias("r")), "_right")
    scored = cuts.select("keys", "a", F.struct(F.expr(SCORE).alias("score"), "cut", "l", "r").alias("c"))
    scored = scored.groupBy("keys", "a").agg(F.min("c").alias("c"))
    # the largest count of a longer phrase around each
    spots = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("keys") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.size("keys") - n + 1), lambda i: F.slice("keys", i, n)),
    )))
    around = phrases.filter(F.size("keys") > 2).select(spots.alias("keys"), "a").groupBy("keys").agg(F.max("a").alias("_longer"))
    left = scored.join(around, "keys", "left").filter(F.expr(f"_longer IS NULL OR 100 * _longer < {int(within)} * a"))
    left = left.join(frequent.select(F.col("key").alias("_first"), "code"), F.get("keys", F.lit(0)) == F.col("_first")).drop("_first")
    left = left.join(langs, "code").drop("code")
    # ties at the end stay until phrases are spelt
    ranked = left.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a")))).filter(
        F.col("_rank") <= top
    )
    ranked = written(ranked, "ranked")
    places = ranked.select("keys", F.posexplode("keys").alias("_at", "key"))
    names = texts.filter(F.col("word").isNotNull()).select("key", "word").join(places.select("key").distinct(), "key")
    spelt = places.join(names.groupBy("key").agg(F.min("word").alias("word")), "key")
    spelt = spelt.groupBy("keys").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    return (
        ranked.join(spelt, "keys").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("size").alias("n"), F.col("c.score").cast("long").alias("score"))
    )
