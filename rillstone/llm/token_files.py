"""Token ids as files of bit-packed blocks.

Each id takes the fewest bits that hold every id of the vocabulary. A file is a run of blocks in ascending ``doc_id``
order; a block has the ids of whole documents one after the other, the count of each, and its offset in the file, so a
reader unpacks it with a few numpy operations and finds any position without reading what is before it. A small table
beside the files has the number of ids in each file. Files are Parquet tables of blocks, so that they can be on any
store that Spark reaches.

Defined cases: a null text is an empty one; a document without tokens is its end id alone. Rows without ``doc_id`` come
last, repeated ids stay together. An empty table gives no blocks.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rillstone.llm import bpe
from rillstone.llm.multiset_hash import id_runs

#: Ids in a block, unless one document has more.
BLOCK = 1 << 16
#: Pieces a worker remembers; none of more than ``bpe.LONGEST`` characters.
REMEMBERED = 1_000_000
BLOCKS = "file int, first_id long, at long, width int, doc_ids binary, no_id binary, counts binary, packed binary"


def width_of(vocabulary_size: int) -> int:
    return max(1, math.ceil(math.log2(max(2, vocabulary_size))))


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, most significant first."""
    if width % 8 == 0:  # whole bytes
        return ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width // 8 :].tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack(packed: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first`` on."""
    if width % 8 == 0:
        size = width // 8
        out = np.zeros((count, 4), np.uint8)
        out[:, 4 - size :] = np.frombuffer(packed, np.uint8, count * size, first * size).reshape(count, size)
        return out.view(">u4").ravel().astype(np.uint32)
    lead = first * width
    raw = np.frombuffer(packed, np.uint8, count=-(-(lead % 8 + count * width) // 8), offset=lead // 8)
    bits = np.unpackbits(raw)[lead % 8 : lead % 8 + count * width].reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, 32 - width :] = bits
    return np.packbits(out, axis=1).view(">u4").ravel().astype(np.uint32)


class _Library:
    """The tokenizers library, asked once for each piece that a worker remembers. A piece between blanks is
    encoded as it is inside its text; texts in which that is not certain are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bpe.plain(t) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        known = self.known
        for i in range(0, len(texts), 256):  # a part of the batch at a time
            split = {k: bpe.short_pieces(texts[k]) for k in range(i, min(i + 256, len(texts))) if plain[k]}
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*split.values()).difference(known))
            for p, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, np.uint32).tobytes()
            for k, s in split.items():
                out[k] = np.frombuffer(b"".join(map(known.__getitem__, s)), np.uint32)
            for p in new:
                if len(p) > bpe.LONGEST:
                    del known[p]
        rest = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int) -> None:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to each and write the blocks to ``path/blocks`` and the
    number of ids in each file to ``path/files``."""

    def encode(batches):
        coder = _library(vocabulary)
        width = width_of(coder.size)
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            for i in range(0, len(texts), 1024):
                ids = [np.append(x, np.uint32(end_id)) for x in coder.encode(texts[i : i + 1024])]
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].iloc[i : i + 1024].astype("Int64"), "n": [len(x) for x in ids],
                    "packed": [pack(x, width) for x in ids],
                })

    def block(batches):
        """Documents in order, as they come, into blocks."""
        width = width_of(_library(vocabulary).size)
        number, at, held, total = -1, 0, [], 0

        def done():
            ids = np.concatenate([unpack(p, width, 0, n) for _, n, p in held])
            names = [d for d, _, _ in held]
            missing = np.array([d is pd.NA or d is None or d != d for d in names])
            kept = np.array([0 if m else d for d, m in zip(names, missing, strict=True)], np.int64)
            return pd.DataFrame([(
                number, int(kept[0]), at, width, kept.tobytes(), np.packbits(missing).tobytes(),
                np.array([n for _, n, _ in held], np.int64).tobytes(), pack(ids, width),
            )], columns=["file", "first_id", "at", "width", "doc_ids", "no_id", "counts", "packed"])

        for rows in batches:
            for run, d, n, p in zip(rows["run"], rows["doc_id"].astype("Int64"), rows["n"].tolist(), rows["packed"], strict=True):
                if held and (total + n > BLOCK or run != number):
                    yield done()
                    at, held, total = at + total, [], 0
                if run != number:
                    number, at = run, 0
                held.append((d, n, p))
                total += n
        if held:
            yield done()

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    coded = read.mapInPandas(encode, "doc_id long, n long, packed binary")
    # one file for each run of neighbouring ids; a run is whole in a task, in order
    spread = coded.withColumn("run", id_runs(docs)).repartition("run")
    order = ["run", F.col("doc_id").asc_nulls_first(), F.xxhash64("packed")]
    blocks = spread.sortWithinPartitions(*order).mapInPandas(block, BLOCKS)
    blocks.write.parquet(f"{path}/blocks")
    written = docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks")
    counted = written.groupBy("file").agg(
        F.max("at").alias("_last"),
        F.max_by(F.struct("counts"), "at").alias("_c"),
    )

    def totals(batches):
        for rows in batches:
            last = [int(np.frombuffer(c["counts"], np.int64).sum()) for c in rows["_c"]]
            yield pd.DataFrame({"file": rows["file"], "ids": rows["_last"].to_numpy() + np.array(last, np.int64)})

    counted.mapInPandas(totals, "file int, ids long").coalesce(1).write.parquet(f"{path}/files")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids in all files and blocks before them. The window is over one row per
    file."""
    files = spark.read.schema("file int, ids long").parquet(f"{path}/files")
    before = F.sum("ids").over(Window.orderBy("file")) - F.col("ids")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(
        files.select("file", before.alias("_base")), "file"
    ).withColumn("start", F.col("at") + F.col("_base")).drop("_base")


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start`` of all files on; positions after the end give fewer. Files and blocks
    without them are passed over, and of a block only the bits asked for are unpacked."""
    end = start + count
    before = F.sum("ids").over(Window.orderBy("file"))
    files = spark.read.schema("file int, ids long").parquet(f"{path}/files").select("file", before.alias("_end"), (before - F.col("ids")).alias("_base"))
    near = {r["file"]: r["_base"] for r in files.filter((F.col("_base") < end) & (F.col("_end") > start)).collect()}
    room = F.octet_length("packed") * 8 / F.col("width")
    base = F.element_at(F.create_map(*(F.lit(x) for pair in near.items() for x in pair)), F.col("file")) if near else F.lit(0)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(F.col("file").isin(list(near)))
    blocks = blocks.withColumn("start", F.col("at") + base).filter((F.col("start") < end) & (F.col("start") + room > start))
    out = [np.empty(0, np.uint32)]
    for r in blocks.select("start", "width", "counts", "packed").orderBy("start").toLocalIterator():
        first, last = max(0, start - r["start"]), min(end - r["start"], int(np.frombuffer(r["counts"], np.int64).sum()))
        if last > first:
            out.append(unpack(bytes(r["packed"]), r["width"], first, last - first))
    return np.concatenate(out)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def run(batches):
        for rows in batches:
            for r in rows.itertuples():
                counts = np.frombuffer(r.counts, np.int64)
                ids = unpack(r.packed, r.width, 0, int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                missing = np.unpackbits(np.frombuffer(r.no_id, np.uint8))[: len(counts)].astype(bool)
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(np.frombuffer(r.doc_ids, np.int64).copy(), missing),
                    "start": r.start + ends - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(counts, ends, strict=True)],
                })

    return read_blocks(spark, path).select("start", "width", "doc_ids", "no_id", "counts", "packed").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
