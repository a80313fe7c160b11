"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources get weights; each has a target of words, at most ``repeats`` times what it holds, and what is cut off there is
shared among the others by weight. Documents of a source are put in a random but fixed order, again for each repeat,
and a copy's virtual finish time is the words of its source up to its end over the source's target. Copies are taken
in order of finish time, over all sources, until the budget is used.

Running sums are made in two levels, so that no source, however large, is in one task: sums of buckets first (a bucket
is a slice of the random order), then rows inside their bucket. The point where the budget ends is found in the same
way. Only the row of that point goes to the driver.

Defined cases: a null text has size 0; a null source is a source and comes last; documents of size 0 take nothing. Rows
with the same source, id and size are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.llm.blocks import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows for which a slice of a source's random order and of the scale of finish times is made, and bits of the fewest.
ROWS, FEWEST = 50_000, (10, 12)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: float) -> DataFrame:
    """``source, number, source_size, target`` of each source of ``sizes(source, size)``: the level at which
    ``sum(min(repeats * size, level * weight))`` is the budget, times the weight. Windows here are over sources."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    row = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = by.withColumn("number", row).withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    s = s.withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "number")
    every = Window.partitionBy(F.lit(1))
    less = F.sum("most").over(order) - F.col("most")
    heavier = F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight")
    # the level is the largest of what each number of filled sources would give
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - less) / heavier
    s = s.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return s.select("source", "number", "source_size", F.least("most", F.col("_level") * F.col("weight")).alias("target"))


def _ticket(seed: int) -> Column:
    """The place of a row in the random order of its source: 60 bits of a digest of its id and size."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17,
    keep_source: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, and ``source`` if asked for, of every row of
    ``docs(doc_id, text, source)``."""
    sizes = written(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
        .withColumn("ticket", _ticket(seed)),
        "sizes",
    )
    # as many slices as the rows ask for, so that a task's share stays the same
    wanted = math.ceil(math.log2(max(1, sizes.count() / ROWS)))
    slice_bits, bins = max(FEWEST[0], wanted), 1 << max(FEWEST[1], wanted)
    sources = written(targets(sizes, weights, share, repeats), "targets")
    named = sources.withColumnRenamed("source", "_source")
    base = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    base = base.withColumn("slice", F.shiftright("ticket", 60 - slice_bits))
    sums = base.groupBy("number", "slice").agg(F.sum("size").alias("_sum"))
    before = sums.select(
        F.col("number").alias("_n"), F.col("slice").alias("_s"),
        (F.sum("_sum").over(Window.partitionBy("number").orderBy("slice")) - F.col("_sum")).alias("_before"),
    )
    inside = Window.partitionBy("number", "slice").orderBy("ticket", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = base.withColumn("_in", F.sum("size").over(inside)).join(
        before, (F.col("number") == F.col("_n")) & (F.col("slice") == F.col("_s"))
    )
    done = written(
        placed.select(
            "doc_id", "source", "size", "source_size", "target", "number", "ticket", (F.col("_in") + F.col("_before")).alias("ends")
        ),
        "order",
    )

    def finish(copy: int) -> Column:
        at = (F.col("ends") + F.lit(copy) * F.col("source_size")) / F.col("target")
        return F.when((F.col("size") > 0) & (F.col("target") > 0), at)

    def point(copy: int) -> Column:
        return F.struct(
            finish(copy).alias("finish"), F.col("number"), F.col("ticket"), F.col("doc_id"), F.col("size"),
            F.lit(copy).alias("copy"),
        )

    copies = done.select(F.explode(F.array(*(point(c) for c in range(repeats)))).alias("p"), "size").filter("p.finish IS NOT NULL")
    copies = copies.withColumn("bin", F.least(F.floor(F.col("p.finish") * bins), F.lit(2 * bins)))
    budget = F.lit(sources.agg(F.coalesce(F.round(F.sum("target")), F.lit(0)).cast("long")).first()[0])
    upto = copies.groupBy("bin").agg(F.sum("size").alias("_sum")).withColumn(
        "_upto", F.sum("_sum").over(Window.orderBy("bin"))
    )
    cut_bin = upto.filter(F.col("_upto") > budget).orderBy("bin").select("bin", F.col("_upto") - F.col("_sum")).first()
    if cut_bin is None:
        taken = F.lit(repeats) * F.col("size")
    else:
        running = F.sum("size").over(Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
        last = (
            copies.filter(F.col("bin") == cut_bin[0]).withColumn("_run", running + F.lit(cut_bin[1]))
            .filter(F.col("_run") > budget).agg(F.min("p").alias("p")).select("p.*").first()
        )
        end = F.struct(
            F.lit(last["finish"]).alias("finish"), F.lit(last["number"]).alias("number"), F.lit(last["ticket"]).cast("long").alias("ticket"),
            F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"),
            F.lit(last["copy"]).alias("copy"),
        )
        taken = sum((F.when(point(c) < end, F.col("size")).otherwise(F.lit(0)) for c in range(repeats)), F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0))
    more = ["source"] if keep_source else []
    return done.select("doc_id", *more, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all columns. Rows with the same id
    and source are taken alike, as often as the one that is taken most. Rows without words are kept once."""
    sized = mix(docs, weights, share, repeats, keep_source=True)
    times = sized.groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source")).agg(
        F.max(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1)).cast("int").alias("_times")
    )
    same = docs["doc_id"].eqNullSafe(times["_mix_id"]) & docs["source"].eqNullSafe(times["_mix_source"])
    often = F.explode(F.array_repeat(F.lit(0), times["_times"])).alias("_copy")
    return docs.join(times, same).select(*(docs[c] for c in docs.columns), often).drop("_copy")
