"""Latent Dirichlet topics by online variational Bayes, the method of Spark's ``LDA``, with the weights in a table.

Spark's model is a matrix of topics by words on the driver, beside a list of all words. Here each word is a row with its
``k`` weights: a batch of documents is joined with the rows of its words, documents are settled in tasks, and what they
add to a word is summed by word. The driver holds ``k`` numbers. Batches, step sizes and the update of the documents' prior are Spark's.

Defined cases: null and empty documents count for the size of the corpus and say nothing about topics.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.runtime import written

#: Share of documents in a batch; the step of batch n is (DELAY + n) ** -DECAY; shape of the gamma that weights start from.
SHARE, DELAY, DECAY, SHAPE = 0.05, 1024.0, 0.51, 100.0


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out -= np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out += np.where(small, 1 / (x * x), 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def _start(term: Column, topic: int, seed: int) -> Column:
    """A gamma draw of mean 1 by a hash of the word, from a normal one (Wilson and Hilferty)."""
    u, v = ((F.pmod(F.xxhash64(term, F.lit(2 * topic + i), F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52) for i in (0, 1))
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    return F.pow(1 - 1 / (9 * SHAPE) + z / (3 * math.sqrt(SHAPE)), 3)


def _times(u: Column) -> Column:
    """Poisson draws of mean ``SHARE``: how often a document is in a batch."""
    term, total, out = math.exp(-SHARE), 0.0, None
    for n in range(6):
        total += term
        out = F.when(u < total, n) if out is None else out.when(u < total, n)
        term *= SHARE / (n + 1)
    return out.otherwise(6)


def batches(df: DataFrame, words: str, turns: int, seed: int) -> DataFrame:
    """``turn, doc, words`` of the documents that are drawn; ``doc`` has an id and how often it counts."""
    drawn = df.select(F.col(words).alias("words"), F.array(*(_times(F.rand(seed + i)) for i in range(turns))).alias("_all"))
    each = drawn.filter(F.exists("_all", lambda n: n > 0)).select(
        F.monotonically_increasing_id().alias("id"), "words", F.posexplode("_all").alias("turn", "times")
    )
    return written(each.filter("times > 0").select("turn", F.struct("id", "times").alias("doc"), "words"), "batches")


def settle(rows: pd.DataFrame, totals: np.ndarray, prior: np.ndarray):
    """What the documents in ``rows(id, times, term, n, weights)``, whole and in order, add to their words; and under no
    word the sum of their expected log shares, with their number."""
    d = np.cumsum(np.diff(rows["id"].to_numpy(), prepend=rows["id"].iloc[0]) != 0)
    first = np.flatnonzero(np.diff(d, prepend=-1))
    n, times = rows["n"].to_numpy(float), rows["times"].to_numpy(float)
    beta = np.exp(digamma(np.stack(rows["weights"].to_numpy())) - totals)

    def expected(gamma: np.ndarray) -> np.ndarray:
        return digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]

    gamma = np.ones((len(first), len(prior)))
    theta, live = np.exp(expected(gamma)), np.ones(len(first), bool)
    while live.any():
        t = live[d]
        b, at = beta[t], (np.cumsum(live) - 1)[d[t]]
        share = n[t] / ((b * theta[live][at]).sum(axis=1) + 1e-100)
        new = theta[live] * np.add.reduceat(b * share[:, None], np.flatnonzero(np.diff(at, prepend=-1))) + prior
        moved = np.abs(new - gamma[live]).mean(axis=1) > 1e-3
        gamma[live], theta[live] = new, np.exp(expected(new))
        live[np.flatnonzero(live)[~moved]] = False
    share = n * times / ((beta * theta[d]).sum(axis=1) + 1e-100)
    yield pd.DataFrame({"term": rows["term"].to_numpy(), "stat": list(theta[d] * beta * share[:, None]), "docs": 0})
    often = times[first]
    yield pd.DataFrame({"term": [None], "stat": [(expected(gamma) * often[:, None]).sum(axis=0)], "docs": [int(often.sum())]})


def _added(counts: DataFrame, model: DataFrame, totals: np.ndarray, prior: np.ndarray) -> DataFrame:
    def run(parts):
        held = None
        for rows in parts:
            rows = rows if held is None else pd.concat((held, rows), ignore_index=True)
            ids = rows["id"].to_numpy()
            last = int(np.argmax(ids == ids[-1])) if len(ids) else 0
            if last:
                yield from settle(rows.iloc[:last], totals, prior)
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield from settle(held, totals, prior)

    met = counts.join(model, "term").select("doc.id", "doc.times", "term", "n", "weights")
    told = met.repartition("id").sortWithinPartitions("id").mapInPandas(run, "term string, stat array<double>, docs long")
    sums = F.array(*(F.sum(F.get("stat", F.lit(t))) for t in range(len(prior))))
    return written(told.groupBy("term").agg(sums.alias("stat"), F.sum("docs").alias("docs")), "added")


def _next_prior(prior: np.ndarray, logs: np.ndarray, docs: int, step: float) -> np.ndarray:
    """One step of Newton, left out where a share would not stay positive."""
    slope = docs * (digamma(prior.sum()) - digamma(prior) + logs / docs)
    c, q = docs * trigamma(prior.sum()), -docs * trigamma(prior)
    b = (slope / q).sum() / (1 / c + (1 / q).sum())
    moved = prior - step * (slope - b) / q
    return moved if (moved > 0).all() else prior


def column_sums(model: DataFrame, k: int) -> np.ndarray:
    """Of each topic the sum of all words' weights."""
    return np.array([x or 0.0 for x in model.agg(*(F.sum(F.get("weights", F.lit(t))) for t in range(k))).first()])


def fit(vocabulary: DataFrame, drawn: DataFrame, size: int, counted, k: int, turns: int, seed: int) -> DataFrame:
    """``term, n, weights`` after all batches. ``vocabulary(term, n)`` has every word, ``drawn`` the batches out of
    ``size`` documents, and ``counted`` makes ``doc, term, n`` of the rows of one."""
    start = F.array(*(_start(F.col("term"), t, seed) for t in range(k)))
    model = written(vocabulary.select("term", "n", start.alias("weights")), "topics")
    prior, scale, step = np.full(k, 1 / k), size / max(1, math.ceil(SHARE * size)), 0
    for turn in range(turns):
        batch = counted(drawn.filter(F.col("turn") == turn).select("doc", "words"))
        added = _added(batch, model.select("term", "weights"), digamma(column_sums(model, k)), prior)
        about = added.filter("term IS NULL").first()
        if about is None:  # no document with words was drawn
            continue
        step += 1
        rate = (DELAY + step) ** -DECAY
        gain = (F.coalesce(F.get("stat", F.lit(t)), F.lit(0.0)) * scale + 1 / k for t in range(k))
        weights = F.array(*((1 - rate) * F.get("weights", F.lit(t)) + rate * g for t, g in enumerate(gain)))
        model = written(model.join(added.drop("docs"), "term", "left").select("term", "n", weights.alias("weights")), "topics")
        prior = _next_prior(prior, np.array(about["stat"]), about["docs"], rate)
    return model
