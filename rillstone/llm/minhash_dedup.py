"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A signature has ``chunks * WIDTH`` symbols of 16 bits, the low bits of one minimum each. Two signatures that differ in
at most ``chunks * (ERRORS + 1) - 1`` symbols agree in some chunk but for ``ERRORS`` symbols (pigeonhole). Each chunk
is therefore sent under one key for every choice of ``ERRORS`` symbols left out, and all pairs within the distance
meet under a key. The number of chunks follows from the similarity, so that a pair that is just similar enough meets under
no key with probability ``MISS`` at most. Pairs become links only when the full shingle sets are similar enough.

Texts with the same set of shingles are one node, known by a digest of the set. A component is compared on full sets
with its smallest node first, block by block, each with a copy of that node's set.

Defined cases: a null, empty or blank text has no shingles and links with nothing. A text of fewer words than a
shingle is one shingle. Rows of one ``doc_id`` with different texts are different texts: each has its own set, and what
is linked to one of them is in their component. Rows without ``doc_id`` link with nothing, have a null component and are
kept. Repeated rows share a component, and all rows with the component's id are kept. Other columns are not read, so
they may have any name.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.llm.blocks import EDGES, bucket_edges, each_group, paired_blocks, sides, written
from rillstone.llm.textbytes import batch_words, mix, shingles
from rillstone.operators.graphs import connected_components

WIDTH, ERRORS, MISS = 4, 1, 1e-5
#: More minima, for the distance that decides which pairs are compared on full sets.
SYMBOLS = 128


def chunks_for(percent: int) -> int:
    """How many chunks it takes so that a pair of this similarity agrees in one of them, but for ``MISS``."""
    p = percent / 100
    agree = sum(math.comb(WIDTH, e) * p ** (WIDTH - e) * (1 - p) ** e for e in range(ERRORS + 1))
    chunks = 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))
    if chunks * WIDTH > SYMBOLS:
        raise ValueError(f"{percent} per cent needs {chunks * WIDTH} symbols; a signature has {SYMBOLS}")
    return chunks


def _keys(symbols: np.ndarray, chunks: int) -> np.ndarray:
    """One row of keys per signature; the number of the chunk and of the choice is part of a key."""
    out = []
    for c in range(chunks):
        for k, skipped in enumerate(combinations(range(WIDTH), ERRORS)):
            h = mix(np.full(len(symbols), c * 1000 + k, np.uint64))
            for i in range(WIDTH):
                if i not in skipped:
                    h = mix(h ^ symbols[:, c * WIDTH + i], i + 1)
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``SYMBOLS`` low halves of minima for each set; sets are not empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    joined = np.concatenate(sets)
    multipliers = mix(np.arange(SYMBOLS, dtype=np.uint64), 11) | np.uint64(1)
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SYMBOLS):
            out[:, i] = np.minimum.reduceat(joined * multipliers[i] + (multipliers[i] >> np.uint64(7)), starts)
    return mix(out) & np.uint64(0xFFFF)


def _sets(texts: list[str | None], width: int):
    """Runs of sorted distinct shingle hashes, one array for each text, in order."""
    for hashes, counts in batch_words(texts):
        ends = np.cumsum(counts)
        yield [np.unique(shingles(hashes[e - n : e], width)) for n, e in zip(counts, ends, strict=True)]


def describe(docs: DataFrame, width: int, chunks: int) -> DataFrame:
    """``doc_id, mark, n_shingles, digest, keys, symbols`` of every row; the last three are null without shingles.
    ``mark`` is a hash of the text, which finds the row again."""

    def run(batches):
        for rows in batches:
            at = 0
            for sets in _sets(rows["text"].tolist(), width):
                full = [s for s in sets if len(s)]
                symbols = _signatures(full) if full else np.empty((0, SYMBOLS), np.uint64)
                keys = iter(_keys(symbols, chunks))
                small = iter(symbols.astype(np.uint16))
                out = [
                    (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(keys), next(small).tobytes())
                    if len(s) else (0, None, None, None)
                    for s in sets
                ]
                frame = pd.DataFrame(out, columns=["n_shingles", "digest", "keys", "symbols"])
                for i, c in enumerate(("doc_id", "mark")):
                    frame.insert(i, c, rows[c].iloc[at : at + len(sets)].to_numpy())
                at += len(sets)
                yield frame

    return _marked(docs).mapInPandas(
        run, "doc_id long, mark long, n_shingles long, digest binary, keys array<long>, symbols binary"
    )


def _marked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``text`` replaced by ``shingles``, the sorted distinct 64-bit hashes of it, as bytes; other columns stay."""
    others = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches):
        for rows in batches:
            at, rest = 0, rows.drop(columns="text")
            for sets in _sets(rows["text"].tolist(), width):
                yield rest.iloc[at : at + len(sets)].assign(shingles=[s.tobytes() for s in sets])
                at += len(sets)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "shingles binary"])
    return texts.select(*(f.name for f in others), "text").mapInPandas(run, schema)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), SYMBOLS)


def _distances(s: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(left) * len(right) <= 1024:
        return (s[left][:, None, :] != s[right][None, :, :]).sum(axis=2, dtype=np.int16)
    out = np.zeros((len(left), len(right)), np.int16)
    for i in range(SYMBOLS):
        out += s[left, i][:, None] != s[right, i][None, :]
    return out


def distance_limit(percent: int) -> int:
    """Symbols in which sets of this similarity differ, with five standard deviations for chance."""
    p = 1 - percent / 100
    return int(SYMBOLS * p + 5 * np.sqrt(SYMBOLS * p * (1 - p)))


def _components(docs: DataFrame, width: int, percent: int, per_block: int) -> DataFrame:
    """``doc_id, mark, n_shingles, first`` of every row: the smallest id of its component, and of the texts with this id
    the one with the smallest ``mark``."""
    limit = distance_limit(percent)
    rows = written(
        describe(docs, width, chunks_for(percent)).withColumn("row", F.monotonically_increasing_id()), "signatures"
    )
    known = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # one row stands for all with the same set
    classes = written(
        known.groupBy("digest").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n")),
        "classes",
    )
    repeats = known.select("digest", "row").join(classes.filter("n > 1").select("digest", "node"), "digest").filter("row != node")
    heads = written(
        known.join(repeats.select("row"), "row", "left_anti").select(F.col("row").alias("node"), "doc_id", "mark", "keys", "symbols"),
        "heads",
    )

    def near(part: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _distances(_matrix(part["symbols"]), left, right) <= limit

    def near_pairs(part: pd.DataFrame) -> np.ndarray:
        return (_matrix(part["symbols_u"]) != _matrix(part["symbols_v"])).sum(axis=1) <= limit

    candidates = bucket_edges(
        heads.select("node", "keys"), heads.select("node", "symbols"), near, near_pairs, per_block
    )
    clusters = written(connected_components(written(candidates, "candidates")), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / F.lit(4 * per_block)).cast("int").alias("blocks"))
    wanted = clusters.join(sizes, "component").join(heads.select("node", "doc_id", "mark"), "node")
    # a text that stands on several rows is taken once, before it is moved
    texts = _marked(docs).join(wanted, ["doc_id", "mark"]).groupBy("component", "blocks", "node").agg(F.first("text").alias("text"))
    full = written(shingle_sets(texts, width), "members")
    piece = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = full.select("component", piece.alias("piece"), F.lit(1).alias("turn"), "node", "shingles").unionByName(
        full.filter("node = component").select(
            "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("piece"), F.lit(0).alias("turn"), "node", "shingles"
        )
    )

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        n, m = len(x), len(y)
        if 100 * min(n, m) < percent * max(n, m):
            return False
        joined = np.concatenate((x, y))
        joined.sort(kind="stable")
        both = int((joined[1:] == joined[:-1]).sum())
        return 100 * both >= percent * (n + m - both)

    def settle(batches):
        """Each node beside the smallest of its component, which comes first in each piece."""
        centre = None
        for part in batches:
            out = []
            for component, turn, node, x in zip(part["component"], part["turn"], part["node"], part["shingles"], strict=True):
                if not turn:
                    centre = np.frombuffer(x, np.uint64)
                else:
                    out.append((node, component, node != component and not linked(np.frombuffer(x, np.uint64), centre)))
            yield pd.DataFrame(out, columns=["node", "component", "_open"])

    settled = written(
        each.repartition("component", "piece").sortWithinPartitions("component", "piece", "turn", "node")
        .mapInPandas(settle, "node long, component long, _open boolean"),
        "settled",
    )
    open_groups = settled.filter("_open").select("component").distinct()
    rest = (
        full.select("node", "shingles").join(settled.join(open_groups, "component", "left_semi"), "node")
        .join(heads.select("node", "symbols"), "node")
    )

    def confirm(part: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(part)
        symbols = _matrix(part["symbols"])
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        node = part["node"].to_numpy()
        distance = _distances(symbols, left, right)
        a, b = np.nonzero(distance <= limit)
        a, b, d = left[a], right[b], distance[a, b]
        if part["_i"].iloc[0] == part["_j"].iloc[0]:
            a, b, d = a[keep := a < b], b[keep], d[keep]
        order = np.argsort(d, kind="stable")
        root = list(range(len(part)))
        done = np.flatnonzero(~part["_open"].to_numpy(bool))
        for x in done.tolist():  # they are linked already
            root[x] = int(done[0])

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if find(x) == find(y):
                continue
            if linked(sets[x], sets[y]):
                root[max(find(x), find(y))] = min(find(x), find(y))
                out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    with_centre = settled.filter("NOT _open AND node != component").select(F.col("component").alias("u"), F.col("node").alias("v"))
    blocks = paired_blocks(rest, "component", "node", per_block)
    links = each_group(blocks, ["component", "_i", "_j"], confirm, EDGES).unionByName(with_centre)
    joined = connected_components(written(links, "links")).select("node", F.col("component").alias("_c"))
    placed = classes.join(joined, "node", "left").select("digest", F.coalesce("_c", "node").alias("_c"), "first")
    lowest = placed.groupBy("_c").agg(F.min("first").alias("_low"))
    of_digest = placed.join(lowest, "_c").select("digest", "_low")
    # rows without shingles are alone
    alone = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    found = rows.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return found.join(of_digest, "digest", "left").select("doc_id", "mark", "n_shingles", F.coalesce("_low", alone).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, per_block: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``: links are pairs of
    documents with ``100 * intersection >= percent * union`` of their distinct shingles."""
    return _components(docs, width, percent, per_block).select(
        "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, with all columns: of the rows with its smallest id one
    of those whose text has the smallest hash. Rows without ``doc_id`` all stay."""
    found = _components(docs, width, percent, 256).filter("doc_id IS NOT NULL")
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    each = written(
        found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(F.max(stays).alias("_stays"), F.count("*").alias("_rows")),
        "stays",
    )
    keys = ["_id", "_mark"]
    rows = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_mark", F.xxhash64(F.col("text").cast("string")))
    # rows without an id match nothing and stay; only rows that stand several times are moved to drop all but one
    alone = rows.join(each.filter("NOT _stays OR _rows > 1").select(*keys), keys, "left_anti")
    several = rows.join(each.filter("_stays AND _rows > 1").select(*keys), keys, "left_semi").dropDuplicates(keys)
    return alone.unionByName(several).select(*docs.columns)
