"""Words that are one letter apart, grouped under the most frequent spelling, by an index of grams of variable length.

The gram dictionary starts from all pairs of letters and grows where a gram is frequent: a gram that more than one in
``DENSE`` places has is replaced by its extensions, up to ``LONGEST`` letters, so its size is bounded and its lists are of
similar length. A word is decomposed into the one gram that begins at each letter; the end of a word counts as a
letter. What one inserted, deleted or replaced letter can change is known for each place of a word: the grams that read
that place. All others are shared with whatever the change leads to, those before it at the same place and with the same
beginning, those after it with the same ending. So of the grams that a place leaves alone the rarest before it and the
rarest after it are enough: both words of a pair pick the same two, and are in both their lists. Words are listed under
such pairs of grams, which merges the two lists; long ones are cut into blocks, and pairs are verified letter by letter.

Defined cases: a null text has no words; a null ``doc_id`` counts as an empty one. Repeated rows count as often as
they stand. Other columns are not read. Without words there are no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.llm.blocks import written
from rillstone.llm.spans import LOWER, runs_of, span_hashes, spans, table
from rillstone.llm.textbytes import SLICE, mix

LETTERS = table([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
END = 1
LONGEST = 4
#: A gram that stands at more than one in so many places is extended.
DENSE = 4096
#: Words in a block of a list.
BLOCK = 2048
#: Words of more letters are compared one pair at a time.
WIDE = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def run_crc(b: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of runs of Latin-1 letters as UTF-8, each after what its ``state`` has seen; all runs at once,
    a letter at a time."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    far = int((size > WIDE).sum())
    for k in order[:far].tolist():
        word = b[start[k] : start[k] + size[k]].tobytes().decode("latin-1").encode()
        out[k] = zlib.crc32(word, int(state[k]) ^ 0xFFFFFFFF)
    order = order[far:]
    c, at = state[order].astype(np.uint32), start[order]
    live = np.searchsorted(-size[order], -np.arange(WIDE), side="left")  # runs that have a letter at each place
    for t in range(WIDE):
        n = int(live[t])
        if not n:
            break
        letter = b[at[:n] + t]
        two = np.flatnonzero(letter >= 0xC0)
        c[two] = _CRC[(c[two] ^ np.uint32(0xC3)) & np.uint32(255)] ^ (c[two] >> np.uint32(8))
        last = np.where(letter >= 0xC0, letter - 0x40, letter).astype(np.uint32)
        c[:n] = _CRC[(c[:n] ^ last) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _buffers(ids: list, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased buffers of about a slice, a byte for each character, the end of each text in it, and the state of
    the crc32 of each ``<doc_id>:``."""
    held, states, total = [], [], 0
    for i, (name, text) in enumerate(zip(ids, texts, strict=True)):
        b = (text or "").encode("latin-1", "replace") + b"\n"
        held.append(b)
        states.append(zlib.crc32(f"{name}:".encode()) ^ 0xFFFFFFFF)
        total += len(b)
        if total >= SLICE or i + 1 == len(texts):
            yield LOWER[np.frombuffer(b"".join(held), np.uint8)], np.cumsum([len(x) for x in held]), np.array(states, np.uint32)
            held, states, total = [], [], 0


def spelt_words(docs: DataFrame, shortest: int, every: int) -> DataFrame:
    """``word, n``: the words of ``docs(doc_id, text)`` of at least so many letters; where ``every`` divides the crc32 of
    ``<doc_id>:<run>``, the letter at crc32 modulo length is left out."""

    def run(batches):
        for rows in batches:
            words, counts = [], []
            for b, ends, states in _buffers(rows["doc_id"].tolist(), rows["text"].tolist()):
                start, end = spans(LETTERS[b])
                size = end - start
                start, end, size = (x[size >= shortest] for x in (start, end, size))
                h = run_crc(b, start, size, states[np.searchsorted(ends, start, side="right")])
                cut = h % np.uint32(every) == 0
                for s, n, k in zip(start[cut].tolist(), size[cut].tolist(), h[cut].tolist(), strict=True):
                    if n > shortest:
                        word = b[s : s + n].tobytes().decode("latin-1")
                        words.append(word[: k % n] + word[k % n + 1 :])
                        counts.append(1)
                start, end = start[~cut], end[~cut]
                at, n = runs_of(span_hashes(b, start, end))
                words += [b[s:e].tobytes().decode("latin-1") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                counts += n.tolist()
            yield pd.DataFrame({"word": words, "n": counts}).groupby("word", as_index=False, sort=False)["n"].sum()

    read = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return read.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of the same length as rows of letters with the end mark, and their positions."""
    size = np.array([len(w) for w in words])
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        letters = np.frombuffer("".join(words[i] for i in at.tolist()).encode("latin-1"), np.uint8).reshape(len(at), k)
        yield at, np.concatenate((letters, np.full((len(at), 1), END, np.uint8)), axis=1)


def _grams(letters: np.ndarray, n: int) -> np.ndarray:
    """All grams of ``n`` letters as numbers, a column for each place."""
    out = np.zeros((len(letters), max(0, letters.shape[1] - n + 1)), np.uint32)
    for i in range(n):
        out = out << np.uint32(8) | letters[:, i : i + out.shape[1]]
    return out


class Dictionary:
    """Counts of grams by number of letters; the frequent ones of fewer than ``LONGEST`` are extended."""

    def __init__(self):
        self.grams: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        self.limit = 0

    def add(self, n: int, gram: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(gram)
        self.grams[n], self.counts[n] = gram[order], count[order]

    def count(self, n: int, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams[n], gram), len(self.grams[n]) - 1)
        return np.where(self.grams[n][at] == gram, self.counts[n][at], 0) if len(self.grams[n]) else np.zeros(gram.shape, np.int64)

    def decompose(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and count of the gram that begins at each letter but the end mark."""
        places = letters.shape[1] - 1
        size = np.full((len(letters), places), 2, np.int8)
        count = self.count(2, _grams(letters, 2))
        for n in range(3, LONGEST + 1):
            grams = _grams(letters, n)
            k = grams.shape[1]
            longer = (size[:, :k] == n - 1) & (count[:, :k] > self.limit)
            size[:, :k][longer] = n
            count[:, :k][longer] = self.count(n, grams)[longer]
        return size, count


def gram_dictionary(words: DataFrame) -> Dictionary:
    """Grown level by level: grams of a level are counted where their beginning is frequent. At most ``DENSE`` grams of a
    level are, so what the driver collects and sends is bounded by ``DENSE`` times the letters there are."""
    out = Dictionary()
    places = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    out.limit = max(1, int(places) // DENSE)
    for n in range(2, LONGEST + 1):
        def count(batches, n=n, known=out):
            for rows in batches:
                held = []
                for _, letters in _matrices(rows["word"].tolist()):
                    grams = _grams(letters, n)
                    held.append(grams[known.count(n - 1, grams >> np.uint32(8)) > known.limit] if n > 2 else grams.ravel())
                gram, many = np.unique(np.concatenate(held) if held else np.empty(0, np.uint32), return_counts=True)
                yield pd.DataFrame({"gram": gram.astype(np.int64), "n": many})

        level = words.select("word").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        out.add(n, level.column("gram").to_numpy().astype(np.uint32), level.column("n").to_numpy())
    return out


def _edit_keys(letters: np.ndarray, dictionary: Dictionary) -> Iterator[np.ndarray]:
    """Keys of words of the same length, a row of them for each place of a change: of the grams that the change leaves
    alone, the rarest one before it with all that precedes, and the rarest one after it with all that follows. A word
    has a key for each of its letters, should that be replaced or left out, and for each place between, should a letter
    be put in there; whichever two words differ there have the same key."""
    rows, length = len(letters), letters.shape[1] - 1
    size, count = dictionary.decompose(letters)
    place = np.arange(length)
    reads = place + size - 1  # the last letter that a gram reads
    weight = np.log2(np.maximum(count, 1))
    # a gram with more letters before or after it has a shorter list; ties go to the outermost
    head = weight - 3.0 * place + 1e-7 * place
    tail = weight - 3.0 * np.maximum(0, length - reads) + 1e-7 * (length - place)
    # the best ending from each letter on
    rest, rest_key = np.full((rows, length + 1), np.inf), np.zeros((rows, length + 1), np.uint64)
    ending = mix(letters[:, length].astype(np.uint64), 6)
    for j in range(length - 1, -1, -1):
        ending = mix(ending ^ letters[:, j].astype(np.uint64), 6)
        better = tail[:, j] < rest[:, j + 1]
        rest[:, j] = np.where(better, tail[:, j], rest[:, j + 1])
        rest_key[:, j] = np.where(better, ending, rest_key[:, j + 1])
    best, best_key = np.full(rows, np.inf), np.zeros(rows, np.uint64)
    beginning = np.zeros(rows, np.uint64)

    def key(j: int) -> np.ndarray:
        return mix(best_key ^ mix(rest_key[:, j], 7), 8)

    for i in range(length + 1):
        if i:  # beginnings that read up to the letter before
            beginning = mix(beginning ^ letters[:, i - 1].astype(np.uint64), 5)
            for p in range(max(0, i - LONGEST), i - 1):
                better = (reads[:, p] == i - 1) & (head[:, p] < best)
                best, best_key = np.where(better, head[:, p], best), np.where(better, beginning, best_key)
        yield key(i)
        if i < length:
            yield key(i + 1)


def index(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``key, word, n``: each word under the keys of its changes, once each."""
    held = words.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        for rows in batches:
            names, n = rows["word"].to_numpy(), rows["n"].to_numpy()
            for at, letters in _matrices(names.tolist()):
                part = max(1, 400_000 // letters.shape[1])
                for i in range(0, len(at), part):
                    own = at[i : i + part]
                    found = list(_edit_keys(letters[i : i + part], held.value))
                    key, word = np.concatenate(found), np.tile(np.arange(len(own), dtype=np.uint64), len(found))
                    once, _ = runs_of(mix(key ^ word), word, key)
                    whose = own[word[once].astype(np.int64)]
                    yield pd.DataFrame({"key": key[once].view(np.int64), "word": names[whose], "n": n[whose]})

    return words.mapInPandas(run, "key long, word string, n long")


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def _verified(letters: np.ndarray, size: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one letter apart."""
    out = np.zeros(len(a), bool)
    far = (size[a] > WIDE) | (size[b] > WIDE)
    for k in np.flatnonzero(far).tolist():
        out[k] = one_apart(words[a[k]], words[b[k]])
    same = np.flatnonzero(~far & (size[a] == size[b]))
    out[same] = (letters[a[same]] != letters[b[same]]).sum(axis=1) == 1
    more = np.flatnonzero(~far & (np.abs(size[a] - size[b]) == 1))
    x, y = np.where(size[a[more]] > size[b[more]], a[more], b[more]), np.where(size[a[more]] > size[b[more]], b[more], a[more])
    x, y = letters[x], letters[y]
    lead = np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
    trail = np.logical_and.accumulate((x[:, 1:] == y[:, :-1])[:, ::-1], axis=1).sum(axis=1)
    out[more] = lead + trail >= x.shape[1] - 1
    return out


def near_pairs(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n, other, other_n``: all words that share a key and are one letter apart, both ways, once."""
    lists = index.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select(
        "key", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks")
    )
    cut = index.join(lists, "key").withColumn("_b", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    ).select("key", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "word", "n")

    def merge(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs inside runs of rows of the same list and blocks: each row with the next, the one after it, and so on."""
        words, n, own = rows["word"].to_numpy(), rows["n"].to_numpy(), rows["_b"].to_numpy()
        cross = (rows["_i"] != rows["_j"]).to_numpy()
        size = np.array([len(w) for w in words])
        width = int(min(size.max(), WIDE)) + 1
        letters = np.frombuffer(b"".join(w[:width].encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        new = np.append(True, np.any([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in ("key", "_i", "_j")], axis=0))
        first = np.flatnonzero(new)
        left = np.repeat(np.append(first[1:], len(rows)), np.diff(np.append(first, len(rows)))) - np.arange(len(rows)) - 1
        at, step = np.flatnonzero(left > 0), 1
        while len(at):
            to = at + step
            good = np.flatnonzero(~cross[at] | (own[at] != own[to]))
            a, b = at[good], to[good]
            hit = np.concatenate([_verified(letters, size, words, a[i : i + 200_000], b[i : i + 200_000]) for i in range(0, len(a), 200_000)] or [np.empty(0, bool)])
            a, b = a[hit], b[hit]
            if len(a):
                yield pd.DataFrame({
                    "word": np.concatenate((words[a], words[b])), "n": np.concatenate((n[a], n[b])),
                    "other": np.concatenate((words[b], words[a])), "other_n": np.concatenate((n[b], n[a])),
                })
            step += 1
            at = at[left[at] >= step]

    def run(batches):
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat((held, rows), ignore_index=True)
            last = rows.iloc[-1]
            open_ = (rows["key"] == last["key"]) & (rows["_i"] == last["_i"]) & (rows["_j"] == last["_j"])
            held, done = rows[open_], rows[~open_].reset_index(drop=True)
            if len(done):
                yield from merge(done)
        if held is not None and len(held):
            yield from merge(held.reset_index(drop=True))

    # a list of one block, or a pair of blocks, is whole in a task
    dealt = cut.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    return dealt.mapInPandas(run, "word string, n long, other string, other_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms are followed to the last, twice as far each time. A form stands at
    least twice as often as its word, so ways are short and have no ring."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(now.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, times: int = 2, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``shortest`` letters that stands ``least`` times:
    its form is the near word of the largest n, if that is ``times`` its own or more."""
    if shortest <= LONGEST:
        raise ValueError(f"words need more than {LONGEST} letters, the longest gram, so that a change leaves one alone")
    words = written(spelt_words(docs, shortest, every).filter(F.col("n") >= least), "words")
    pairs = written(near_pairs(written(index(words, gram_dictionary(words)), "index"), block), "pairs")
    near = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.when(F.col("other_n") >= times * F.col("n"), F.struct((-F.col("other_n")).alias("_minus"), "other"))).alias("_form"),
    )
    near = written(near.select("word", "n_near", F.col("_form.other").alias("form"), (-F.col("_form._minus")).alias("form_n")), "near")
    roots = _roots(near.filter("form IS NOT NULL"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
