"""Byte-pair encoding of whole texts with a public vocabulary file, and decoding back to its strings.

A piece of text becomes a doubly linked list of symbols; a priority queue holds the merges of neighbours by rank, and
an entry whose symbols have changed since is skipped when it comes up. Pieces repeat, so each worker keeps the results
of the short pieces it has met, up to a fixed number. Text is split as the file's settings say: special tokens first, then
canonical composition, one space for each run of white space, lower case letter by letter, and the file's pattern. Texts
of common letters are split here; others by the library's normaliser and pattern, whose Unicode tables may be newer than
Python's.

Defined cases: a null text is an empty one; an empty or blank text has no tokens and decodes to the empty string.
Rows keep their ``doc_id``, null or repeated; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

WORD_END = "</w>"
#: Pieces a worker remembers, and the most characters of one.
REMEMBERED, LONGEST = 400_000, 64
#: Unicode white space.
_BLANK = "\t-\r \x85\xa0  -     　"
#: Letters with marks of their own, where neither composition nor lower case needs a look at the neighbours.
_PLAIN_TO = 0x21F


def _class(kind: str) -> str:
    """The characters of a kind among common ones and what those become in lower case."""
    common = "".join(map(chr, range(_PLAIN_TO + 1)))
    return "".join(re.escape(c) for c in sorted({*common, *common.lower()}) if unicodedata.category(c)[0] == kind)


_PLAIN = re.compile(f"[\t\n\r -~\xa1-{chr(_PLAIN_TO)}]*")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_FAST = re.compile(
    f"{_ENDINGS}|[{_class('L')}]+|[{_class('N')}]|[^{_BLANK}{_class('L')}{_class('N')}]+"
)


def plain(text: str) -> bool:
    """Whether the short way of ``pieces`` gives what the long one does."""
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


def short_pieces(text: str) -> list[str]:
    return _FAST.findall(text.lower())


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others counted on from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else more))
        more += b not in printable
    return out


class Encoder:
    """A vocabulary file: ids of strings, ranks of merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.ids: dict[str, int] = held["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.letters = byte_letters()
        self.bytes = {ord(c): b for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.known: dict[str, tuple[str, str, int]] = {}

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text between special tokens, in order."""
        if plain(text):
            return short_pieces(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, map(ord, p))).decode("utf-8", "replace") for p, _ in found]

    def symbols(self, piece: str) -> list[str]:
        """The strings of a piece's tokens."""
        s = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        s[-1] += WORD_END
        n, rank = len(s), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank((s[i], s[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i] if s[i] == a else -1
            if j < 0 or s[j] != b:
                continue  # stale
            s[i], s[j] = a + b, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((s[i], s[k]))) is not None:
                    heapq.heappush(queue, (r, i, s[i], s[k]))
            h = before[i]
            if h >= 0 and (r := rank((s[h], s[i]))) is not None:
                heapq.heappush(queue, (r, h, s[h], s[i]))
        return [x for x in s if x]

    def piece(self, piece: str) -> tuple[str, str, int]:
        """Decimal ids and strings of a piece's tokens, each joined by a space, and their number."""
        found = self.known.get(piece)
        if found is None:
            ids = [self.ids[x] for x in self.symbols(piece)]
            found = (" ".join(map(str, ids)), self.decode(ids), len(ids))
            if len(piece) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def parts(self, text: str) -> list[tuple[str, str, int]]:
        if "<|" not in text or self.cut is None:
            known, out = self.known.get, []
            for p in self.pieces(text):
                out.append(known(p) or self.piece(p))
            return out
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append((str(self.special[part]), part, 1))
            else:
                out.extend(self.piece(p) for p in self.pieces(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, one after the other; the file has no decoder, so a space stands between them."""
        return " ".join(self.strings[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row of ``docs``."""
    return _run(docs, vocabulary, lambda ids, _: (np.fromstring(ids, np.int32, sep=" "),), "ids array<int>", ["ids"])


def decode_ids(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, decoded`` for every row of ``tokens(doc_id, ids)``; null for null ids. An id that the vocabulary does
    not have raises."""

    def run(batches):
        coder = encoder(vocabulary)
        for rows in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in rows["ids"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "decoded": pd.Series(texts, dtype=object, index=rows.index)})

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, decoded string")


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the decimal ids and of what they decode to."""
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    names = ["ids_sha256", "decoded_sha256"]
    return _run(docs, vocabulary, lambda ids, text: (sha(ids), sha(text)), "ids_sha256 string, decoded_sha256 string", names)


def _run(docs: DataFrame, vocabulary: str, give, schema: str, names: list[str]) -> DataFrame:
    def run(batches):
        coder = encoder(vocabulary)
        for rows in batches:
            out, counts = [], []
            for text in rows["text"]:
                parts = coder.parts(text or "")
                ids, strings, n = zip(*parts, strict=True) if parts else ((), (), ())
                counts.append(sum(n))
                out.append(give(" ".join(ids), " ".join(strings)))
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "n_tokens", counts)
            frame.insert(0, "doc_id", rows["doc_id"].to_numpy())
            yield frame.astype({"n_tokens": "int64"})

    read = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInPandas(run, f"doc_id {kind}, n_tokens long, {schema}")
