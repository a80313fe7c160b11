"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Text is folded first: letters without their marks and special forms, signs of no width left out, lower case, look-alike
letters of other scripts as Latin ones, digits and signs between letters, or one or two after the last, as the letters
they stand for. Lexicon entries are whole words, or beginnings of words, that labelled toxic documents
have far more often than others; the weight is the logarithm of the ratio. Phrases of an entry and a neighbour that are
common in clean documents are exceptions and take the weight back. The sum of weights, by itself and over the number of
words, gives a probability by logistic regression on documents that the lexicon was not learnt from.

Defined cases: a null, empty or wordless text has no matches and gets the score of a text without matches. With no
labelled rows of both kinds the lexicon is empty and all scores are 0. Labels without a document, null labels and rows
without ``doc_id`` are not learnt from; all rows are scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.llm.labelled import SAMPLE, held_out, training_texts

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
_ALIKE = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнαεορχυικντβηωа", "aeopcyxijsdhlkmtbhaeopxyikvtbnwa"
)
_SIGNS = str.maketrans("0134578@$!", "oieastbasi")
_OTHER = re.compile("[Ͱ-ԯ]")
#: Marks that stand on letters, and signs of no width.
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_BETWEEN = re.compile(r"(?<=[^\W\d_])[0-9@$!]+(?=[^\W\d_])|(?<![\w@$!])[0-9@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_])[013457@$]{1,2}(?![\w@$!])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if _OTHER.search(text):
        text = text.translate(_ALIKE)
    return _WORD.findall(_BETWEEN.sub(lambda m: m[0].translate(_SIGNS), text))


@dataclass
class Lexicon:
    """Weights of patterns; a pattern starts with a space, and ends with one if it is whole words."""

    weights: dict[str, float]
    exceptions: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        every = [*self.weights.items(), *((p, -w) for p, w in self.exceptions.items())]
        if not every:
            return None
        out = ahocorasick.Automaton()
        for p, w in every:
            out.add_word(p, w)
        out.make_automaton()
        return out


def _features(texts: list[str], found) -> np.ndarray:
    """Logarithm of the weights, and weights per hundred words."""
    out = np.zeros((len(texts), 2))
    for k, text in enumerate(texts):
        words = fold(text or "")
        if found is not None and words:
            total = max(0.0, sum(w for _, w in found.iter(f" {' '.join(words)} ")))
            out[k] = math.log1p(total), 100 * total / len(words)
    return out


def _odds(n1: DataFrame, totals: tuple[int, int]):
    ones, zeros = totals
    return F.log((F.col("n1") + 0.5) / (ones + 1)) - F.log((F.col("n0") + 0.5) / (zeros + 1))


def _counted(rows: DataFrame, key: str, of) -> DataFrame:
    """``key, n1, n0``: in how many toxic and other texts ``of(words)`` has a string."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for x in of(fold(text)):
                    counts.setdefault(x, [0, 0])[1 - label] += 1
            yield pd.DataFrame([(x, a, b) for x, (a, b) in counts.items()], columns=[key, "n1", "n0"])

    found = rows.select("text", "label").mapInPandas(run, f"{key} string, n1 long, n0 long")
    return found.groupBy(key).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, ratio: float = 2.0,
    support: float = 0.004, beginnings: tuple[int, int] = (4, 8),
) -> Lexicon:
    """A lexicon from at most ``sample`` labelled documents: entries are in a share of ``support`` of the toxic ones
    at least (and in five), so their number is bounded, and ``exp(ratio)`` times as often there as in others."""
    rows = training_texts(docs, labels, label, sample)
    totals = {r["label"]: r["n"] for r in rows.filter("part < 7").groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return Lexicon({})
    build = rows.filter("part < 7")
    words = _counted(build, "word", set)
    starts = words.select(
        F.explode(F.transform(
            F.filter(F.sequence(F.lit(beginnings[0]), F.lit(beginnings[1])), lambda n: n < F.length("word")),
            lambda n: F.concat(F.lit(" "), F.substring("word", F.lit(1), n)),
        )).alias("pattern"), "n1", "n0",
    ).groupBy("pattern").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    whole = words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("pattern"), "n1", "n0")
    least = max(5, support * ones)
    kept = whole.unionByName(starts).filter(F.col("n1") >= least).withColumn("w", _odds(words, (ones, zeros))).filter(F.col("w") >= ratio)
    weights: dict[str, float] = {}
    for pattern, w in sorted(((r["pattern"], r["w"]) for r in kept.select("pattern", "w").collect()), key=lambda x: (len(x[0]), x[0])):
        # an entry that begins with another, and says no more, is left out
        if not any(pattern[:n] in weights and weights[pattern[:n]] >= w - 0.7 for n in range(2, len(pattern))):
            weights[pattern] = w
    lexicon = Lexicon(weights)
    found = lexicon.automaton()
    if found is None:
        return lexicon

    def phrases(folded: list[str]) -> set[str]:
        out = set()
        for k, word in enumerate(folded):
            if any(True for _ in found.iter(f" {word} ")):
                out.update(f" {' '.join(folded[i : i + 2])} " for i in (k - 1, k) if 0 <= i < len(folded) - 1)
        return out

    common = _counted(build, "phrase", phrases).filter("n0 >= 5").withColumn("w", _odds(words, (ones, zeros))).filter("w <= 0.5")
    for r in common.select("phrase").collect():
        lexicon.exceptions[r["phrase"]] = max(0.0, sum(w for _, w in found.iter(r["phrase"])))
    scored = sorted(features(rows.filter("part >= 7"), lexicon).collect(), key=lambda r: (r["label"], r["x"]))
    if len({r["label"] for r in scored}) == 2:
        lexicon.coefficients = _logistic(np.array([r["x"] for r in scored]), np.array([r["label"] for r in scored]))
    return lexicon


def features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``label, x`` of training texts."""

    def run(batches):
        found = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": list(_features(batch["text"].tolist(), found))})

    return rows.select("text", "label").mapInPandas(run, "label int, x array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``."""

    def run(batches):
        found = lexicon.automaton()
        a, b, c = lexicon.coefficients
        for rows in batches:
            x = _features(rows["text"].tolist(), found)
            p = 1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30)))
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "score": p, "predicted": (p >= 0.5).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all columns. Text is scored in place, so nothing
    is joined or moved."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = lexicon.automaton()
        a, b, c = lexicon.coefficients
        for texts in batches:
            x = _features([t or "" for t in texts], found)
            yield pd.Series(1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30))))

    return docs.filter(scored(docs["text"].cast("string")) < threshold)
