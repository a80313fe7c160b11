"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, repeated passages are cut
out, sources are mixed to their weights, and what is left is encoded. Each stage takes all rows of the one before."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rillstone.functions.runtime import small_batches, use_utc
from rillstone.llm import bpe, fair_mix, minhash_dedup, substring_dedup, toxicity
from rillstone.llm.blocks import written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    """A stage may be run by itself on any session, so it sets the session up, and not only the whole run does."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(small_batches(use_utc(spark)), docs, sf_dir)

    return run


@prepared
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the lexicon is learnt from labels of the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


@prepared
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links of 80 per cent of five-word shingles join."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80)


@prepared
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay where they come first; elsewhere they are cut out of the text."""
    return substring_dedup.drop_repeats(docs)


@prepared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in turn weigh 3, 1 and 2, and give one and a half times all words, none more than twice its own."""
    return fair_mix.mixed(docs, weights=(3, 1, 2), share=1.5, repeats=2)


@prepared
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("fair_mix", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the learnt lexicon nor the byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(use_utc(spark)).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
