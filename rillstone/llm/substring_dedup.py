"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends before a word where the hash of the sixteen bytes before it
falls below a bound. Stretches of more than ``MOST`` bytes without such a cut, as in scripts without spaces, are cut at
characters instead, by the same hash and a lower bound. Whether a place is a cut depends only on the bytes around it and
on the cuts next to it, so an insertion moves no cut further on.
Chunks are counted by digest over all documents. Neighbouring chunks that occur elsewhere make a span, and spans of
enough bytes are reported; of each chunk the first occurrence, by ``doc_id`` and place, is kept.

Defined cases: a null or empty text has no chunks. Text that has neither kind of cut, as one word over and over, is cut
every ``MOST`` bytes from the cut before it, at a character. Capitals count: passages that differ in case are different passages.
Rows with the same ``doc_id`` are taken for the same document; rows without ``doc_id`` are neither searched nor changed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rillstone.functions.runtime import settled
from rillstone.llm.blocks import written
from rillstone.llm.textbytes import SLICE, SPACE, _DOWN, _UP, as_bytes, mix

_GEAR = mix(np.arange(256, dtype=np.uint64), 3).astype(np.uint32)
_ONE, _TWO = mix(np.arange(256, dtype=np.uint64), 21), mix(np.arange(256, dtype=np.uint64), 22)
#: Bytes the hash looks at; one place in 2^RARE before a word is a cut; least and most bytes of a chunk.
WINDOW, RARE, LEAST, MOST = 16, 2, 12, 128
#: One byte in 2^FINE is a cut at a character: by the first byte of a character, the bound of the hash before it.
FINE = 5
_BOUND = np.repeat(np.array([1, 0, 2, 3, 4], np.uint32) << np.uint32(32 - FINE), [128, 64, 32, 16, 16])


def gear(b: np.ndarray) -> np.ndarray:
    """The gear hash of the last ``WINDOW`` bytes at each place, by doubling; the first places lack bytes."""
    h, n = _GEAR[b], 1
    while n < WINDOW:
        later = h.copy()
        later[n:] += h[:-n] << np.uint32(n)
        h, n = later, 2 * n
    return h


def _fine(c: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``c`` with those ``places`` that lie in stretches of more than ``MOST`` bytes."""
    before = np.searchsorted(c, places, side="right") - 1
    wide = np.append(np.diff(c) > MOST, False)[before]
    places, before = places[wide], before[wide]
    apart = (np.diff(places, prepend=-LEAST) >= LEAST) & (places - c[before] >= LEAST)
    return np.union1d(c, places[apart])


def cuts(b: np.ndarray) -> np.ndarray:
    """Places where chunks begin, the first at 0, and the end of the text."""
    found, fine = [], []
    for at in range(0, len(b), SLICE):
        start = max(0, at - WINDOW)
        part = b[start : at + SLICE]
        h, first = gear(part), max(at, WINDOW) - start
        begins = np.flatnonzero(SPACE[part[:-1]] & ~SPACE[part[1:]]) + 1
        begins = begins[begins >= first]
        found.append(begins[h[begins - 1] >> np.uint32(32 - RARE) == 0] + start)
        fine.append(np.flatnonzero(h[first - 1 : -1] < _BOUND[part[first:]]) + first + start)
    c = np.concatenate(found) if found else np.empty(0, np.int64)
    # a cut that follows another too closely goes, whatever became of the other
    c = c[np.diff(c, prepend=-LEAST) >= LEAST] if len(c) else c
    c = np.unique(np.concatenate(([0], c, [len(b)])))
    if (np.diff(c) > MOST).any():
        c = _fine(c, np.concatenate(fine))
    wide = np.flatnonzero(np.diff(c) > MOST)
    if len(wide):
        more = np.concatenate([np.arange(c[k] + MOST, c[k + 1], MOST) for k in wide])
        for _ in range(3):  # not inside a character
            inside = (more > 0) & ((b[np.minimum(more, len(b) - 1)] & 0xC0) == 0x80)
            more = more - inside
        c = np.unique(np.concatenate((c, more)))
    return c


def chunk_digests(b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each chunk, in runs of chunks of at most a slice."""
    one, two, k = [], [], 0
    with np.errstate(over="ignore"):
        while k < len(c) - 1:
            last = max(k + 1, int(np.searchsorted(c, c[k] + SLICE, side="right")) - 1)
            part, ends = b[c[k] : c[last]], c[k : last + 1] - c[k]
            for table, out in ((_ONE, one), (_TWO, two)):
                total = np.concatenate(([np.uint64(0)], np.cumsum(table[part] * _UP[: len(part)], dtype=np.uint64)))
                out.append(mix((total[ends[1:]] - total[ends[:-1]]) * _DOWN[ends[:-1]] + np.diff(ends).astype(np.uint64)))
            k = last
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(one or empty).view(np.int64), np.concatenate(two or empty).view(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, one, two, ends, again``: of the chunks of each document the digest in two parts, the ends, and whether
    the document has had the chunk before."""

    def run(batches):
        for rows in batches:
            for i in range(0, len(rows), 512):
                out = []
                for t in rows["text"].iloc[i : i + 512]:
                    b = np.frombuffer(as_bytes(t), np.uint8)
                    c = cuts(b) if len(b) else np.zeros(1, np.int64)
                    one, two = chunk_digests(b, c)
                    again = np.ones(len(one), bool)
                    again[np.unique(one ^ two, return_index=True)[1]] = False
                    out.append((one, (two >> 32).astype(np.int32), c[1:], again))
                frame = pd.DataFrame(out, columns=["one", "two", "ends", "again"])
                frame.insert(0, "doc_id", rows["doc_id"].iloc[i : i + 512].to_numpy())
                yield frame

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return read.mapInPandas(run, "doc_id long, one array<long>, two array<int>, ends array<int>, again array<boolean>")


def repeated_spans(docs: DataFrame, least: int = 64) -> DataFrame:
    """``doc_id, first_byte, end_byte, n_chunks, kept, first_doc_id``: spans of at least ``least`` bytes made of chunks
    that occur more than once in ``docs(doc_id, text)``. ``kept`` spans are first occurrences, the others repeat
    text of which ``first_doc_id`` has a first occurrence."""
    held = written(chunks(docs), "chunks")
    each = held.select("doc_id", "ends", F.posexplode(F.arrays_zip("one", "two", "again")).alias("k", "c"))
    counted = each.groupBy("c.one", "c.two").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"), F.max("c.again").alias("_again")
    )
    # every chunk is moved twice, once to its count and once to what is repeated: the one is off the disk before the other
    often = settled(counted.filter("first_doc_id < _last OR _again").select("one", "two", "first_doc_id"), "repeated")
    end = F.element_at("ends", F.col("k") + 1).cast("long")
    size = F.when(F.col("k") > 0, end - F.element_at("ends", F.greatest(F.col("k"), F.lit(1)))).otherwise(end)
    # every chunk is moved, so its row is narrow: 32 bits of the digest and 32 of the place, 32 of the end, 31 of the size, one of again
    packed = each.select(
        "doc_id", F.col("c.one").alias("_one"), F.shiftleft(F.col("c.two").cast("long"), 32).bitwiseOR(F.col("k").cast("long")).alias("_place"),
        F.shiftleft(end, 32).bitwiseOR(F.shiftleft(size, 1)).bitwiseOR(F.col("c.again").cast("long")).alias("_end"),
    )
    low = F.lit((1 << 32) - 1)
    met = packed.join(often, (F.col("_one") == F.col("one")) & (F.shiftright("_place", 32) == F.col("two").cast("long")))
    occurring = met.select(
        "doc_id", F.col("_place").bitwiseAND(low).cast("int").alias("k"), F.shiftright("_end", 32).cast("int").alias("end"),
        F.shiftright(F.col("_end").bitwiseAND(low), 1).cast("int").alias("size"),
        ((F.col("_end").bitwiseAND(F.lit(1)) == 0) & (F.col("doc_id") == F.col("first_doc_id"))).alias("kept"), "first_doc_id",
    )
    # chunks that follow each other have the same difference to their rank, and repeated rows have the same rank
    order = Window.partitionBy("doc_id", "kept").orderBy("k")
    runs = occurring.withColumn("run", F.col("k") - F.dense_rank().over(order))
    return (
        runs.groupBy("doc_id", "kept", "run")
        .agg(
            F.min(F.col("end") - F.col("size")).cast("long").alias("first_byte"), F.max("end").cast("long").alias("end_byte"),
            (F.max("k") - F.min("k") + 1).cast("long").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"),
        )
        .filter(F.col("end_byte") - F.col("first_byte") >= least)
        .select("doc_id", "first_byte", "end_byte", "n_chunks", "kept", "first_doc_id")
    )


def drop_repeats(docs: DataFrame, least: int = 64) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` and ``n_chars`` counted again, if it is there; all rows stay."""
    spans = repeated_spans(docs, least).filter("NOT kept").groupBy(F.col("doc_id").alias("_span_id")).agg(
        F.array_sort(F.collect_list(F.struct("first_byte", "end_byte"))).alias("_spans")
    )
    gone = settled(spans, "spans")  # the chunks are off the disk before the texts are moved

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            b, at, kept = as_bytes(t), 0, []
            for x in s:
                kept.append(b[at : x["first_byte"]])
                at = x["end_byte"]
            out.append(b"".join([*kept, b[at:]]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["_span_id"], "left")
    text = F.when(gone["_spans"].isNull(), docs["text"]).otherwise(cut(docs["text"], gone["_spans"]))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(gone["_spans"].isNull(), docs["n_chars"]).otherwise(F.char_length(text).cast(kind))
    return joined.select(*(changed.get(c, docs[c]).alias(c) for c in docs.columns))
