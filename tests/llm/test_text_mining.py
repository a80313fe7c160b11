"""Phrases, passages of test items and spelling variants against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import collocations, contamination, spelling
from rillstone.llm.spans import Lookup, runs_of, span_hashes, spans

SCHEMA = "doc_id long, text string, lang string, source string, key long, n long, k0 string, word string, rank int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 7, 8, "x", "y", 9) for i, t, lang in rows], SCHEMA)


def sentences(seed, n, vocabulary="the a of one two tree Häuser x9 日本".split()):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sentences(i, 120), ["en", "fr", None][i % 3]) for i in range(30)]
    rows += [(0, sentences(0, 120), "en"), (None, sentences(5, 50), "en"), (40, None, "en"), (41, "", "de"), (42, " \t.\n", None)]
    rows += [(43, "a" * 3000 + " the tree", "en"), (44, sentences(44, 60_000), "fr"), (45, "the tree", "xx\0y")]
    return table(spark, rows)


def phrases_of(rows, words, least, within, top):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\n\x0b-\x0d]", lower(r.text)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    kept = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    longer = collections.defaultdict(int)
    for k, a in kept.items():
        w = k[1:]
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (k[0], *w[i : i + size])
                longer[part] = max(longer[part], a)
    out = collections.defaultdict(list)
    for k, a in kept.items():
        if 100 * longer[k] >= within * a:
            continue
        w = k[1:]
        score, i = min((10**6 * a * a // (f[(k[0], *w[:i])] * f[(k[0], *w[i:])]), i) for i in range(1, len(w)))
        out[k[0]].append((-score, -a, " ".join(w).encode(), f[(k[0], *w[:i])], f[(k[0], *w[i:])]))
    return {
        (lang, j, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items() for j, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.mark.parametrize("words, least, within, top, per_trie", [(3, 10, 50, 2000, 1 << 21), (3, 3, 50, 40, 700), (4, 2, 30, 10**6, 5000), (2, 5, 50, 7, 150)])
def test_collocations(spark, docs, words, least, within, top, per_trie):
    got = collocations.collocations(docs, words, least, within, top, per_trie)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for t, _ in got.dtypes} >= {"lang"} and dict(got.dtypes)["score"] == "bigint"
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == phrases_of(docs.collect(), words, least, within, top)


def test_collocations_without_rows(spark, docs):
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.filter("doc_id = 45")).collect() == []


def test_texts_are_read_once(spark, docs):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    few = docs.filter("doc_id < 30").cache()
    got = collocations.collocations(few.withColumn("text", seen("text")), 3, 3, 50, 40, 700).count()
    assert got > 0 and read.value == few.count()


def test_shared_keys_are_noticed(spark):
    rows = [(1, "en", "a", 1, 5, False), (1, "en", "a", 2, 5, False), (2, "en", "b", 1, 6, False), (2, "en", "c", 1, 7, False), (3, "fr", "d", 1, 8, True)]
    words, langs = collocations.count_words(spark.createDataFrame(rows, "key long, lang string, word string, n long, other long, shared boolean"), 0)
    assert {r["key"]: (r["n"], r["shared"]) for r in words.collect()} == {1: (3, False), 2: (2, True), 3: (1, True)}
    assert {r["lang"]: r["size"] for r in langs.collect()} == {"en": 5, "fr": 1}


@pytest.mark.parametrize("size", [1, 2, 300, 1 << 30])
def test_windows_of_a_block(size):
    r = np.random.default_rng(1)
    places = [np.minimum(r.zipf(1.3, 2000), size).astype(np.uint32) - np.uint32(1) for _ in range(3)]
    found, n = collocations._windows(places, size)
    assert dict(zip(zip(*(f.tolist() for f in found), strict=True), n.tolist(), strict=True)) == collections.Counter(zip(*(p.tolist() for p in places), strict=True))
    assert len(collocations._windows([p[:0] for p in places], size)[1]) == 0


def test_collocation_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_007)], "a long, l long, r long")
    assert row.selectExpr(collocations.SCORE).first()[0] == 10**6 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_007)


def test_trie_finds_every_phrase():
    r = np.random.default_rng(4)
    word = r.integers(0, 2**63, 700).astype(np.uint64)
    two = np.unique(word[np.minimum(r.zipf(1.3, (4000, 2)) - 1, 699)], axis=0)
    three = np.unique(np.concatenate((two[r.integers(0, len(two), 900)], word[r.integers(0, 700, (900, 1))]), axis=1), axis=0)
    trie = collocations.Trie([two, three])
    assert trie.size == len(two) + len(three)
    text = word[np.minimum(r.zipf(1.2, 50_000) - 1, 699)]
    text[::97] = 1  # a word of no phrase
    joint = r.random(len(text)) < 0.9
    joint[-1] = False
    got = np.bincount(trie.find(Lookup(trie.keys).find(text), joint), minlength=trie.size)
    seen = collections.Counter()
    for i in range(len(text) - 1):
        if joint[i]:
            seen[text[i], text[i + 1]] += 1
            if joint[i + 1]:
                seen[text[i], text[i + 1], text[i + 2]] += 1
    assert got.tolist() == [seen[tuple(p)] for p in np.concatenate((two.astype(object).tolist(),)).tolist()] + [seen[tuple(p)] for p in three.tolist()]


def test_hashes_do_not_depend_on_slices():
    r = random.Random(2)
    text = " ".join("x" * r.randint(1, 9) + str(i % 50) for i in range(400_000)) + " " + "y" * 1_200_000 + " end"
    b = np.frombuffer(text.encode(), np.uint8)
    start, end = spans(b != 32)
    whole = span_hashes(b, start, end)
    words = text.split(" ")
    assert len(words) == len(whole)
    by_word = {}
    for w, h in zip(words, whole.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    at, n = runs_of(whole)
    assert {words[i]: k for i, k in zip(at.tolist(), n.tolist(), strict=True)} == collections.Counter(words)


def passages_of(rows, items, size):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))

    held = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(size, len(w))
        for j in range(len(w) - k + 1) if k else ():
            held[tuple(w[j : j + k])].add(i)
    out = []
    for r in rows:
        w, found = words(r.text), set()
        hit = [False] * len(w)
        for k in range(1, size + 1):
            for j in range(len(w) - k + 1):
                if (x := held.get(tuple(w[j : j + k]))) is not None:
                    found |= x
                    hit[j : j + k] = [True] * k
        names = sorted(str(x) for x in found if x is not None)
        out.append((r.doc_id, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, per_group", [(10, 1 << 25), (3, 1 << 25), (3, 2000)])
def test_contaminated(spark, docs, size, per_group):
    long = lower(docs.filter("doc_id = 44").first().text)
    items = [(i, sentences(i, 30)) for i in range(8)] + [(8, "One, TWO"), (9, "日本"), (10, None), (11, " . "), (None, "x9 x9"), (8, "tree tree tree")]
    items += [(100, long[5000:5600]), (20, "nowhere to be seen " * 10), (21, sentences(3, 30))]
    frame = spark.createDataFrame([(i, t, 5, "z") for i, t in items], "item_id long, text string, doc_id long, hits string")
    got = contamination.contaminated(docs, frame, size, per_group)
    assert sorted((tuple(r) for r in got.collect()), key=str) == passages_of(docs.collect(), items, size)
    spans_of = contamination.marked(docs, frame, size, per_group).filter("n_hit > 0").collect()
    for r in spans_of:
        each = np.frombuffer(r.hits, np.int64).reshape(-1, 2)
        assert (each[:, 1] - each[:, 0] + 1).sum() == r.n_hit


def test_contaminated_without_rows(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    got = contamination.contaminated(docs, none).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)
    assert contamination.contaminated(docs.limit(0), none).collect() == []


def variants_of(rows, shortest, least, every, times):
    n = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if spelling.one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * k else None
    out = set()
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, k, len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(5, 11))) for _ in range(60)] + ["straße", "naïvely", "x" * 80, "x" * 81, "ÿ×÷ÿ×÷"]
    def bent(w):
        i, k = r.randrange(len(w)), r.random()
        return w[:i] + (r.choice("abcdeé") if k < 0.66 else "") + w[i + (k > 0.33) :]
    pool = base + [bent(w) for w in base for _ in range(6)]
    weights = [1 / (1 + i % 23) for i in range(len(pool))]
    texts = [" ".join(x if k % 7 else x.upper() for k, x in enumerate(r.choices(pool, weights, k=200))) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, texts[1], "en"), (99, None, "en"), (98, "", "en"), (97, "日本 ab1cd", "en"), (96, " ".join(base) * 300, "en")]
    docs = table(spark, rows)
    want = variants_of(docs.collect(), 5, 3, 7, 2)
    for block in (2048, 3):
        got = spelling.spelling_variants(docs, every=7, block=block)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
    assert sum(1 for x in want if x[1]) > 20 and any(x[1] != x[2] for x in want if x[1])
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="letters"):
        spelling.spelling_variants(docs, shortest=4)


@pytest.mark.parametrize("letters, limit", [("ab", 1), ("ab", 50), ("abcé", 3), ("abc", 10**9)])
def test_words_one_apart_share_a_key(letters, limit):
    r = random.Random(limit)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(500)})
    held = spelling.Dictionary()
    held.limit = limit
    for n in range(2, spelling.LONGEST + 1):
        grams = []
        for _, m in spelling._matrices(words):
            g = spelling._grams(m, n)
            grams.append(g[held.count(n - 1, g >> np.uint32(8)) > limit] if n > 2 else g.ravel())
        held.add(n, *np.unique(np.concatenate(grams), return_counts=True))
    keys = collections.defaultdict(set)
    for at, m in spelling._matrices(words):
        for row in spelling._edit_keys(m, held):
            for i, k in zip(at.tolist(), row.tolist(), strict=True):
                keys[words[i]].add(k)
    for a, b in itertools.combinations(words, 2):
        assert not spelling.one_apart(a, b) or keys[a] & keys[b]


def test_crc_of_runs():
    r = random.Random(3)
    words = ["".join(r.choice("abé×ÿz") for _ in range(r.randint(1, 90))) for _ in range(300)]
    b = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    size = np.array([len(w) for w in words])
    state = np.full(len(words), zlib.crc32(b"17:") ^ 0xFFFFFFFF, np.uint32)
    assert spelling.run_crc(b, np.cumsum(size) - size, size, state).tolist() == [zlib.crc32(f"17:{w}".encode()) for w in words]
