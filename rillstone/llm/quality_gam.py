"""Text quality by a generalised additive model with pairwise interactions.

Every document gets a few measures of its whole text. Each measure is cut into bins, and boosting goes round the measures
one at a time with shallow trees at a small rate, so that each measure ends with a table of one number per bin; pairs of
measures that explain most of what is left get tables in the same way. A score is the logistic function of the sum of
looked-up numbers, made for a batch by vectorised additions.

The tables are fitted on the driver from at most ``SAMPLE`` labelled rows of measures. All documents are scored.

Defined cases: a null text is an empty one, whose measures are all 0. With labels of one kind only, every score is that
label's share. Labels without a document and null labels are not learnt from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.llm.labelled import SAMPLE, held_out, training_texts

MEASURES = (
    "log_words", "word_length", "upper", "digits", "signs", "stops", "line_length", "distinct_words", "distinct_lines",
    "top_word", "short_words", "long_words", "doubled", "signed_words", "wide_letters", "line_ends",
)
_SIGN = re.compile(r"[^\w\s.,;:'\"()?-]|_")
_END = re.compile(r"[.!?,;:]")
BINS, PAIR_BINS, PAIRS = 48, 12, 10


def measure(text: str) -> list[float]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.split()
    if not words:
        return [0.0] * len(MEASURES)
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper = chars - len(re.sub("[A-ZÀ-Þ]", "", text))
    signs = len(_SIGN.findall(text))
    return [
        math.log(n), (chars - n + 1) / n, upper / chars, (chars - len(re.sub("[0-9]", "", text))) / chars, signs / chars,
        len(_END.findall(text)) / n, math.log(chars / len(lines)), len(counts) / n, len(set(lines)) / len(lines),
        max(counts.values()) / n, float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, signs / n, (len(text.encode("utf-8", "replace")) - len(text)) / chars,
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
    ]


@dataclass
class Tables:
    """Bin edges and a table per measure, coarse edges and a table per pair, and the base."""

    base: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.single, strict=True)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        if self.pairs:
            c = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
            for a, b, t in self.pairs:
                total += t[c[a], c[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """A shallow tree on ordered bins: the cuts that gain most, one after the other, and a Newton step per leaf."""
    cuts = [0, len(g)]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def value(a, b):
        return (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)

    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = (G[c] - G[a]) ** 2 / (H[c] - H[a] + ridge) + (G[b] - G[c]) ** 2 / (H[b] - H[c] + ridge) - value(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(c[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a table, one along each side, with a Newton step per quadrant, and its gain."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.arange(1, len(g))[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)

    def four(S):
        return S[i, j], S[i, -1] - S[i, j], S[-1, j] - S[i, j], S[-1, -1] - S[i, -1] - S[-1, j] + S[i, j]

    gains = sum(a**2 / (b + ridge) for a, b in zip(four(G), four(H), strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    x, y = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, x + 1), slice(x + 1, None)):
        for cols in (slice(0, y + 1), slice(y + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gains[x, y]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.08) -> Tables:
    """Cyclic boosting of measures, then of pairs."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    base, width = math.log(share / (1 - share)), len(MEASURES)
    edges = [_edges(x[:, f], BINS) if len(x) else np.empty(0) for f in range(width)]
    coarse = [_edges(x[:, f], PAIR_BINS) if len(x) else np.empty(0) for f in range(width)]
    single = [np.zeros(len(e) + 1) for e in edges]
    out = Tables(base, edges, single, coarse, [])
    if len(np.unique(y)) < 2:
        return out
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    total = np.full(len(x), base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            n = len(single[f])
            step = rate * _tree(np.bincount(at[f], g, n), np.bincount(at[f], h, n))
            single[f] += step
            total += step[at[f]]
    c = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]

    def table(a, b, v):
        return np.bincount(c[a] * sizes[b] + c[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = sorted(((_quadrants(table(a, b, g), table(a, b, h))[0], a, b) for a in range(width) for b in range(a)), reverse=True)
    tables = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in gains[:PAIRS]]
    for _ in range(pair_rounds):
        for a, b, t in tables:
            g, h = slopes()
            step = rate * _quadrants(table(a, b, g), table(a, b, h))[1]
            t += step
            total += step[c[a], c[b]]
    out.pairs = tables
    return out


def measured(rows: DataFrame) -> DataFrame:
    """``label, x`` of training texts."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [measure(t or "") for t in batch["text"]]})

    return rows.select("text", "label").mapInPandas(run, "label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Tables:
    rows = sorted(measured(training_texts(docs, labels, label, sample)).collect(), key=lambda r: (r["label"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(MEASURES)), np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, tables: Tables, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for rows in batches:
            x = np.array([measure(t or "") for t in rows["text"]]).reshape(len(rows), len(MEASURES))
            p = tables.score(x)
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "score": p, "predicted": (p >= threshold).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
