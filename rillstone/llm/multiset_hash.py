"""Fingerprints of documents as homomorphic multiset hashes, in DataFrame operations only.

A paragraph with its line end, or a sentence of one with the blank after it, or of a long one without sentence ends a run
of words, is hashed to a wide vector; a text's fingerprint is the sum over its pieces, in each place modulo 2^32. It does
not depend on the order of paragraphs, and pieces are added or taken away by adding or subtracting their vectors. The
places are uniform, so different multisets have the same sum with probability 2^-512 or, if the counts of their pieces
differ by multiples of a power of two, somewhat more: 2^-256 for multiples of 2^16.

Likeness has a sketch of its own, sums of random signs. The squared length of such a sum estimates the number of its terms,
so that of the difference of two sums estimates how many pieces differ, and from it the likeness of two texts. The signs
are summed in packed places: a 64-bit hash gives two signs to each of 32 sums, in fields of 32 bits, which no text can
overflow because it has fewer than 2^31 bytes.

Defined cases: a null text is an empty one, which has one empty piece; a line end is put after the last piece of every
text. Rows without ``doc_id`` come last in order; rows with the same id follow each other by the hash of their text.
An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.numbering import dense_ids
from rillstone.llm.blocks import written

#: Hashes of a piece for the fingerprint; each gives two places of 32 bits.
WIDE = 8
#: Hashes of a piece for likeness; each gives 64 signs.
HASHES = 2
#: Where a text is cut: after line ends, and after the end of a sentence.
PIECES = r"(?<=\n)|(?<=[.!?]\s)(?!\n)|(?<=[。！？｡])(?!\n)"
#: A piece of more characters than LONG is also cut after about one in RARE of its words, by the word's hash, and
#: where it still has more than MOST, every MOST. Scripts without spaces have words of one character.
LONG, RARE, MOST = 256, 16, 512
_WORDS = r"(?s)[^\s\x{0E00}-\x{0EFF}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]{1,64}\s?|."
#: Documents in a run of neighbouring ids.
RUN = 4000
#: Runs whose first rows are sent to all tasks.
MOST_SENT = 1 << 20


def _places(text: Column) -> list[Column]:
    """The packed sums of the signs of the piece in the row."""
    field = F.lit(0x0000000100000001)
    out = []
    for seed in range(HASHES):
        h = F.xxhash64(F.lit(seed), text)
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(field)) for i in range(32)]
    return out


def _sums(text: Column) -> list[Column]:
    """Sums of 32-bit halves of hashes of the piece in the row. A text has fewer than 2^31 pieces, so none overflows."""
    out = []
    for seed in range(WIDE):
        h = F.xxhash64(F.lit(-1 - seed), text)
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    return out


def _lanes(sums: list[str], count: str) -> Column:
    """The vector of signed sums, from the packed sums and the number of pieces."""
    low = [F.col(s).bitwiseAND(F.lit(0xFFFFFFFF)) for s in sums]
    high = [F.shiftrightunsigned(F.col(s), 32) for s in sums]
    return F.transform(F.array(*low, *high), lambda x: x * 2 - F.col(count))


def _text_of(sums: list[str]) -> Column:
    """Places modulo 2^32, in hexadecimal."""
    return F.concat(*(F.lpad(F.hex(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for c in sums))


def _squares(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0).cast("long"), lambda s, x: s + x * x)


def _likeness(a: str, b: str) -> Column:
    """1 less the pieces that differ over the pieces of both, from 0 to 1."""
    apart = _squares(F.zip_with(a, b, lambda x, y: x - y))
    return F.greatest(F.lit(0.0), 1 - apart / (_squares(F.col(a)) + _squares(F.col(b))))


def _cut(piece: Column) -> Column:
    """The parts of a piece, which has a line end at its end at most; only long ones have several."""
    marked = F.transform(
        F.regexp_extract_all(piece, F.lit(_WORDS), F.lit(0)),
        lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(RARE)) == 0, F.concat(w, F.lit("\n\n"))).otherwise(w),
    )
    runs = F.filter(F.split(F.array_join(marked, ""), "\n\n"), lambda x: x != "")
    even = F.flatten(F.transform(runs, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{MOST}}}"), F.lit(0))))
    return F.when(F.char_length(piece) > LONG, even).otherwise(F.array(piece))


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, fingerprint, lanes, n_pieces`` for each key of ``rows``; several rows of a key are summed like pieces of
    one text."""
    whole = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    pieces = rows.select(*keys, F.explode(F.split(whole, PIECES)).alias("_piece")).filter("_piece != ''")
    pieces = pieces.select(*keys, F.explode(_cut(F.col("_piece"))).alias("_piece"))
    signs, sums = _places(F.col("_piece")), _sums(F.col("_piece"))
    names, wide = [f"_s{i}" for i in range(len(signs))], [f"_w{i}" for i in range(len(sums))]
    packed = pieces.groupBy(*keys).agg(
        F.count("*").alias("n_pieces"), *(s.alias(n) for s, n in zip([*signs, *sums], [*names, *wide], strict=True))
    )
    return packed.select(*keys, "n_pieces", _text_of(wide).alias("fingerprint"), _lanes(names, "n_pieces").alias("lanes"))


def _run_number(bounds: list[int], doc_id: Column) -> Column:
    """Which run an id is in: its place among the bounds, looked up in two steps; the last run is for null."""
    def listed(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(listed(bounds[::step]), lambda b: b <= doc_id))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(listed(bounds), start + 1, F.lit(step)), lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(F.when(coarse == 0, F.lit(0)).otherwise(start + fine))


def id_runs(docs: DataFrame) -> Column:
    """The number of the run of neighbouring ids that ``doc_id`` is in, ascending; null ids have the last. Ids are numbered in
    order, and every ``RUN``-th is a bound: the driver gets one number for so many documents."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    every = dense_ids(ids, "doc_id", name="_n").filter((F.col("_n") % RUN == 0) & (F.col("_n") > 0))
    bounds = sorted({r[0] for r in every.select("doc_id").toLocalIterator()})
    doc_id = F.col("doc_id").cast("long")
    return _run_number(bounds, doc_id) if bounds else F.when(doc_id.isNull(), 1).otherwise(0)


def with_next(docs: DataFrame) -> DataFrame:
    """``run, place, doc_id, text, next_text, own``: each text with the one of the next id, after the last the first. Ids
    are cut into runs; texts are shuffled once, and the first row of a run also stands, as not ``own``, at the end of
    the run before."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("run", id_runs(docs))
    base = base.withColumn("mark", F.xxhash64("text"))
    first = written(base.groupBy("run").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("_f")), "runs")
    around = Window.orderBy("run")
    last_run = F.max("run").over(Window.partitionBy(F.lit(1)))
    to = first.select(F.col("_f.doc_id").alias("_id"), F.col("_f.mark").alias("_mark"), F.coalesce(F.lag("run").over(around), last_run).alias("_to"))
    # one row for each run, sent to all tasks if they are not very many; of repeated rows one goes on
    found = base.join(F.broadcast(to) if first.count() <= MOST_SENT else to, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    ghosts = found.groupBy(F.col("_to").alias("run")).agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("mark").alias("mark"), F.lit(False).alias("own")
    )
    both = base.withColumn("own", F.lit(True)).unionByName(ghosts)
    order = Window.partitionBy("run").orderBy(F.desc("own"), F.col("doc_id").asc_nulls_last(), "mark")
    return both.select(
        "run", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "own"
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row:
    the second half of each text is replaced by as much of the start of the next one. Each text is hashed once for
    itself and once edited; the next text's sums are those of the next place."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text")).withColumn(
        "edited", F.when(F.col("own"), F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    )
    keys = ["run", "place", "own", "doc_id", "n_chars", "edited_sha256"]
    two = rows.select(
        *keys[:-1], F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))))).alias("t"),
    ).select(*keys, "t.kind", "t.text").filter("own OR kind = 0")
    prints = fingerprints(two, "text", *keys, "kind")
    # runs stay where the texts were, so this moves nothing
    names = ("own_print", "own_lanes", "edit_print", "edit_lanes")
    wide = prints.groupBy(*keys).agg(*(
        F.first(F.when(F.col("kind") == i // 2, F.col(("fingerprint", "lanes")[i % 2])), ignorenulls=True).alias(c)
        for i, c in enumerate(names)
    ))
    along = Window.partitionBy("run").orderBy("place")
    return wide.withColumn("next_lanes", F.lead("own_lanes").over(along)).filter("own").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("own_print").alias("fingerprint"),
        F.col("edit_print").alias("edited_fingerprint"), _likeness("own_lanes", "edit_lanes").alias("near_edited"),
        _likeness("own_lanes", "next_lanes").alias("near_next"),
    )
