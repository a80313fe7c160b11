"""Labelled training rows of bounded number, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The most labelled documents that a model is fitted on. All documents are scored.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that is never learnt from. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """``text, label, part`` of at most ``sample`` labelled documents that are not held out; ``part`` is 0 to 9 by the
    text, so that copies are in the same part. The ids of the sample are broadcast: their number is bounded. Of several
    rows with one id the text with the smallest hash is taken, so the bound holds for rows too."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id")).select("_id", "label", docs["text"].alias("text"))
    single = found.groupBy("_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return single.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "label", F.pmod(F.xxhash64("text"), F.lit(10)).alias("part")
    )
