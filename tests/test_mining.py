from __future__ import annotations

from collections import Counter
from hashlib import md5
from math import factorial, lgamma

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstone.functions.numbering import dense_ids
from rillstone.operators import evaluate, lda, models, patterns, privacy, skipgram, text, vectors
from tests.conftest import SMALL, rows


def test_tokens_ngrams_stopwords(spark):
    df = spark.createDataFrame([(1, "The River, the RIVER-gauge 42!"), (2, " ... "), (3, None)], "k int, t string")
    got = dict(rows(df.select("k", text.tokens("t").alias("w"))))
    assert got[1] == ["the", "river", "the", "river", "gauge", "42"] and got[2] == [] and got[3] is None
    w = df.filter("k = 1").select(text.tokens("t").alias("w"))
    assert w.select(text.without_stopwords("w")).first()[0] == ["river", "river", "gauge", "42"]
    assert w.select(text.ngrams("w", 3)).first()[0][0] == "the river the"
    assert w.select(text.ngrams("w", 7)).first()[0] == []
    with pytest.raises(ValueError):
        text.ngrams("w", 0)


def test_tfidf_of_a_word_in_every_text_is_zero(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"])], "k int, w array<string>")
    got = {(r[0], r[1]): r[4] for r in rows(text.tfidf(df, "k", "w"))}
    assert got[(1, "a")] == 0 and got[(2, "a")] == 0 and got[(1, "b")] == pytest.approx(np.log(3 / 2))


def test_every_word_has_a_vector_and_every_word_counts(spark):
    words = [["a"] * 9 + ["b"] * 6 + ["c"] * 6 + ["d"]]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    # more words than buckets: none is lost
    assert {r["word"] for r in text.word_vectors(df, "w", 2, 2, buckets=2, partitions=1).collect()} == {"a", "b", "c"}
    told = text.topics(df, "w", k=2, terms=4, buckets=1, iterations=1).collect()
    assert [(r["topic"], r["rank"], r["term"]) for r in sorted(told)] == [(0, 1, "a"), (1, 1, "a")]
    assert told[0]["weight"] == pytest.approx(1)


def test_words_do_not_share_vectors(spark):
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([([words[k] for k in r.integers(0, 300, 60)],) for _ in range(80)], "w array<string>")
    got = {x["word"]: tuple(x["vector"]) for x in text.word_vectors(df, "w", 4, 2, partitions=1).collect()}
    assert len(got) > 290 and len(set(got.values())) == len(got)
    told = text.topics(df, "w", k=2, terms=300, iterations=1).collect()
    assert {x["term"] for x in told} == set(got) | set(words) and len(told) == 600


def test_huffman_depths_and_codes():
    counts = np.array([8, 5, 3, 2, 2, 1, 1])
    tree = skipgram.Tree(*skipgram.huffman(counts))
    assert (tree.depth * counts).sum() == 2 + 4 + 5 + 9 + 13 + 22  # what the inner nodes count
    codes = [(tuple(tree.nodes[d][row]), tuple(tree.sides[d][row])) for d, row in zip(tree.depth.tolist(), tree.row)]
    assert len(set(codes)) == 7 and {nodes[-1] for nodes, _ in codes} == {5}
    assert skipgram.Tree(*skipgram.huffman(np.array([4]))).words == 1


def test_pairs_are_all_neighbours_in_a_sentence():
    r = np.random.default_rng(1)
    ids, sentences, half = r.integers(0, 9, 200), np.sort(r.integers(0, 12, 200)), r.integers(1, 6, 200)
    expected = Counter(
        (int(ids[p]), int(ids[q])) for p in range(200) for q in range(200)
        if p != q and abs(p - q) <= half[p] and sentences[p] == sentences[q]
    )
    word, other, n = skipgram.pairs(ids, sentences, half, 9)
    assert dict(zip(zip(word.tolist(), other.tolist()), n)) == expected and (np.diff(word) >= 0).all()


def test_a_step_has_the_gradients_of_every_pair():
    # more neighbours of a word, and words of a neighbour, than one run holds
    r, words = np.random.default_rng(2), 700
    tree = skipgram.Tree(*skipgram.huffman(np.sort(r.integers(5, 500, words))[::-1]))
    keys = np.unique(np.concatenate([3 * words + np.arange(600), np.arange(650) * words + 7, r.integers(0, words**2, 3000)]))
    word, other = np.divmod(keys, words)
    n = r.integers(1, 4, len(keys)).astype(np.float32)
    trainer = skipgram.Trainer(tree, 8, 0)
    trainer.y[:] = r.normal(size=trainer.y.shape)
    x, y = trainer.x.astype(float), trainer.y.astype(float)
    gx, gy = np.zeros_like(x), np.zeros_like(y)
    for w, c, k in zip(word, other, n):
        nodes, sides = (table[int(tree.depth[w])][tree.row[w]] for table in (tree.nodes, tree.sides))
        g = k * (1 - sides - 1 / (1 + np.exp(-y[nodes] @ x[c])))
        gx[c] += g @ y[nodes]
        gy[nodes] += g[:, None] * x[c]
    trainer.step(word, other, n)
    for new, old, g in ((trainer.x, x, gx), (trainer.y, y, gy)):
        rate = skipgram.RATE / (np.sqrt((g * g).mean(axis=1, keepdims=True)) + 1e-6)
        assert np.abs(new - (old + g * rate)).max() < 1e-3


def test_blocks_hold_every_word_in_whole_sentences():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 50, k).tolist() for k in (0, 1, 2500, 999, 1000, 1001, 3, 4000)]
    batches = [pa.record_batch([pa.array(texts[a : a + 3] + [None], pa.list_(pa.int32()))], ["ids"]) for a in range(0, 8, 3)]
    blocks = list(skipgram._blocks(iter(batches), 1000))
    assert np.concatenate([ids for ids, _ in blocks]).tolist() == sum(texts, [])
    sizes = np.unique(np.concatenate([s for _, s in blocks]), return_counts=True)[1]
    assert sizes.tolist() == [1, 1000, 1000, 500, 999, 1000, 1000, 1, 3, 1000, 1000, 1000, 1000]
    assert all(len(ids) <= 1000 for ids, _ in blocks) and not any(set(a[1]) & set(b[1]) for a, b in zip(blocks, blocks[1:]))


def test_words_of_like_use_have_like_vectors(spark):
    r = np.random.default_rng(0)
    groups = [[f"{g}{i}" for i in range(6)] for g in "ab"]
    texts = [([groups[k % 2][i] for i in r.integers(0, 6, 40)],) for k in range(120)]
    # texts without a list count as empty, and words without neighbours have a vector too
    df = spark.createDataFrame([*texts, (None,), ([],), (["alone"],), (["alone"],), (["rare", None],)], "w array<string>").coalesce(1)
    got = {x["word"]: np.array(x["vector"]) for x in text.word_vectors(df, "w", 8, 2, partitions=2).collect()}
    assert set(got) == {*groups[0], *groups[1], "alone"} and all(len(v) == 8 and np.isfinite(v).all() for v in got.values())
    unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
    same = [unit[a] @ unit[b] for g in groups for a in g for b in g if a < b]
    other = [unit[a] @ unit[b] for a in groups[0] for b in groups[1]]
    assert min(same) > max(other)
    again = {x["word"]: np.array(x["vector"]) for x in text.word_vectors(df, "w", 8, 2, partitions=2).collect()}
    assert all((again[w] == v).all() for w, v in got.items())
    with pytest.raises(ValueError):
        text.word_vectors(df, "w", 8, 10**6)


def test_factors_of_any_keys(spark):
    rows = [(f"user {u}", (1 << 40) + i, float(1 + u % 3 + i % 2)) for u in range(12) for i in range(8) if (u + i) % 5]
    df = spark.createDataFrame([*rows, (None, 1 << 40, 3.0)], "u string, i long, r double")
    model = patterns.factorize_keys(df, "u", "i", "r", rank=3, iterations=10)
    asked = spark.createDataFrame([*[(u, i) for u, i, _ in rows], ("nobody", 1 << 40), ("user 1", 7)], "u string, i long")
    got = {(x["u"], x["i"]): x["prediction"] for x in model.predict(asked).collect()}
    assert got["nobody", 1 << 40] is None and got["user 1", 7] is None
    assert np.sqrt(np.mean([(got[u, i] - r) ** 2 for u, i, r in rows])) < 0.35


def test_dense_numbers(spark):
    df = spark.range(0, 5000).selectExpr("cast(id * 7 % 5000 as string) as k").repartition(7)
    got = {r["k"]: r["n"] for r in dense_ids(df, "k", name="n").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(5000))


def test_rows_of_a_block_are_drawn_together(spark):
    df = spark.range(0, 400).selectExpr("id", "id div 100 as block", "cast(id div 100 as double) as v")
    alone = evaluate.bootstrap_mean(df, "v", "id").first()
    blocks = evaluate.bootstrap_mean(df, "v", "block").first()
    assert alone["mean"] == blocks["mean"] == 1.5 and blocks["std_error"] > 4 * alone["std_error"]
    assert evaluate.bootstrap_mean(df.repartition(3), "v", "id").first()["low"] == pytest.approx(alone["low"])


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(round(s, 2)), int(rng.random() < s)) for i, s in enumerate(rng.random(400))]
    return spark.createDataFrame(data, "id int, score double, y int"), data


def test_auc_counts_pairs(scored):
    df, data = scored
    pos = [s for _, s, y in data if y]
    neg = [s for _, s, y in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "score", "y").first()["roc_auc"] == pytest.approx(wins)
    assert evaluate.roc_auc(df, "score", "y", rows_per_chunk=10).first()["roc_auc"] == pytest.approx(wins)
    assert evaluate.binned_roc_auc(df, "score", "y", 100).first()["roc_auc"] == pytest.approx(wins, abs=0.01)
    curve = evaluate.roc_curve(df, "score", "y").orderBy("score").collect()
    assert (curve[0]["tpr"], curve[0]["fpr"]) == (1.0, 1.0)


def test_splits(scored):
    df, _ = scored
    one = rows(evaluate.hash_split(df, "id"))
    assert one == rows(evaluate.hash_split(df.repartition(5), "id"))
    parts = evaluate.stratified_split(df, "id", "y", 0.7).groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t"))
    assert all(r["t"] == int(r["n"] * 0.7) for r in parts.collect())
    big = rows(evaluate.stratified_split(df, "id", "y", 0.7, rows_per_chunk=20))
    assert big == rows(evaluate.stratified_split(df, "id", "y", 0.7))
    assert evaluate.kfold(df, "id", 4).select("fold").distinct().count() == 4


def test_bootstrap_interval_holds_the_mean(scored):
    df, data = scored
    got = evaluate.bootstrap_mean(df, "score", "id").first()
    assert got["low"] < got["mean"] < got["high"]
    sd = np.std([s for _, s, _ in data]) / np.sqrt(len(data))
    assert got["std_error"] == pytest.approx(sd, rel=0.2)
    assert evaluate.bootstrap_mean(df.repartition(6), "score", "id").first()["low"] == pytest.approx(got["low"])


def test_drift(spark):
    a = spark.range(1000).select((F.col("id") / 10.0).alias("v"))
    same = evaluate.drift_psi(a, a, "v").filter("bin IS NULL").first()["psi"]
    moved = evaluate.drift_psi(a, a.select((F.col("v") + 50).alias("v")), "v").filter("bin IS NULL").first()["psi"]
    assert same == pytest.approx(0) and moved > 0.25
    assert evaluate.drift_psi(a, a, "v", small_group=1, accuracy=100).count() == 11


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    got = evaluate.classification_metrics(df, "y", "p").first()
    assert got["accuracy"] == 1.0 and got["precision"] is None and got["recall"] is None
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert evaluate.regression_metrics(perfect, "y", "p").first()["r2"] == 1.0


def test_privacy(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x")], "q string, r int, s string")
    assert tuple(privacy.k_anonymity(df, ["q", "r"], 2).first()) == (1, 2, 1, 1)
    assert rows(privacy.l_diversity(df, ["q"], "s")) == [("a", 2, 2), ("b", 1, 1)]
    noisy = dict(rows(privacy.dp_count(df, ["q"], 1.0, seed="s")))
    assert noisy != {"a": 2.0, "b": 1.0} and noisy == dict(rows(privacy.dp_count(df.repartition(3), ["q"], 1.0, seed="s")))


def test_rules_of_three_items(spark):
    baskets = [(i, x) for i, b in enumerate(["abc", "abc", "ab", "c", "z"]) for x in b]
    df = spark.createDataFrame(baskets + [(0, "a")], "b int, i string")
    sets = {r["itemset"]: r["n"] for r in patterns.frequent_itemsets(df, "b", "i", 0.4).collect()}
    assert sets == {"a": 3, "b": 3, "c": 3, "a,b": 3, "a,c": 2, "b,c": 2, "a,b,c": 2}
    rules = {(r[0], r[1]): r for r in rows(patterns.association_rules(df, "b", "i", 0.4, 0.0))}
    assert rules[("a", "b")][3] == 1.0 and rules[("a", "b")][5] is None
    assert rules[("a,b", "c")][3] == pytest.approx(2 / 3)
    assert rules[("a,b", "c")][4] == pytest.approx((2 / 3) / (3 / 5))


def test_items_that_come_together(spark):
    joint = [(b, f"j{i:02}") for b in range(6) for i in range(14)]
    df = spark.createDataFrame([*joint, *[(b, "k") for b in range(4)], (9, "j00"), (9, "z")], "b int, i string")
    got = {r["itemset"]: r["n"] for r in patterns.frequent_itemsets(df, "b", "i", 0.4).collect()}
    names = [f"j{i:02}" for i in range(14)]
    # j00 stands in one basket more than the others
    assert len(got) == 2 ** 14 - 1 + 2 ** 14 and got["j00"] == 7 and got[",".join(names)] == 6 and got[",".join([*names, "k"])] == 4
    closed = {r["itemset"]: r["n"] for r in patterns.closed_itemsets(df, "b", "i", 0.4).collect()}
    assert closed == {"j00": 7, ",".join(names): 6, ",".join([*names, "k"]): 4}


def test_closed_sets_of_many_items_that_come_together(spark):
    df = spark.createDataFrame([(b, i) for b in range(50) for i in range(60) if i != 59 or b % 2], "b int, i int")
    got = {r["size"]: r["n"] for r in patterns.closed_itemsets(df, "b", "i", 0.2).collect()}
    assert got == {59: 50, 60: 25}


def test_closed_sets_against_all_sets(spark):
    import itertools
    import random

    draw = random.Random(3)
    held = [{x for x in "abcdefg" if draw.random() < 0.6} for _ in range(40)]
    df = spark.createDataFrame([(b, x) for b, s in enumerate(held) for x in s], "b int, i string")
    used = [s for s in held if s]
    n = {frozenset(c): sum(set(c) <= s for s in used) for k in range(1, 8) for c in itertools.combinations("abcdefg", k)}
    n = {c: v for c, v in n.items() if v >= 0.2 * len(used)}
    assert {r["itemset"]: r["n"] for r in patterns.frequent_itemsets(df, "b", "i", 0.2).collect()} == {",".join(sorted(c)): v for c, v in n.items()}
    closed = {c: v for c, v in n.items() if not any(c < d and v == w for d, w in n.items())}
    assert {r["itemset"]: r["n"] for r in patterns.closed_itemsets(df, "b", "i", 0.2).collect()} == {",".join(sorted(c)): v for c, v in closed.items()}


def test_sequences(spark):
    data = [(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "a", 1), (2, "b", 5), (3, "b", 1)]
    df = spark.createDataFrame(data, "g int, e string, t int")
    got = {r["pattern"]: r["n"] for r in patterns.sequential_patterns(df, ["g"], "e", "t", 0.6).collect()}
    assert got == {"a": 2, "b": 3, "a>b": 2}
    # ties are one step, repeats count, runs of equal steps are cut without losing a pattern
    data = [(1, "A", 1), (1, "B", 1), (2, "A", 1), (2, "B", 1), (3, "A", 1), (3, "B", 2), (3, "A", 3)]
    data += [(4, "C", t) for t in range(9)]
    df = spark.createDataFrame(data, "g int, e string, t int")
    got = {r["pattern"]: r["n"] for r in patterns.sequential_patterns(df, ["g"], "e", "t", 0.01, 3).collect()}
    assert got == {
        "A": 3, "B": 3, "C": 1, "A+B": 2, "A>B": 1, "B>A": 1, "A>A": 1, "A>B>A": 1, "C>C": 1, "C>C>C": 1,
    }


def test_similar_items_against_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 3, size=(12, 6)).astype(float)
    df = spark.createDataFrame([(u, i, float(m[u, i])) for u in range(12) for i in range(6) if m[u, i]], "u int, i int, r double")
    seeds = spark.createDataFrame([(0,), (3,)], "i int")
    got = {(r["seed"], r["i"]): r["cosine"] for r in patterns.similar_items(df, seeds, "u", "i", "r", 5).collect()}
    for (a, b), c in got.items():
        assert c == pytest.approx(m[:, a] @ m[:, b] / np.linalg.norm(m[:, a]) / np.linalg.norm(m[:, b]))
    assert len(got) == 10


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.3, size=(60, 3)) for c in (0, 5, -5)])
    data = [(i, [float(v) for v in row], i // 60) for i, row in enumerate(x)]
    return spark.createDataFrame(data, "id int, v array<double>, g int"), x


def test_clusters(blobs):
    df, x = blobs
    for made in (vectors.kmeans(df, "v", 3), vectors.bisecting_kmeans(df, "v", 3)):
        found, cost = made
        groups = found.groupBy("cluster").agg(F.count_distinct("g").alias("k"), F.count("*").alias("n")).collect()
        assert [(r["k"], r["n"]) for r in groups] == [(1, 60)] * 3
        inner = sum(((x[i * 60 : i * 60 + 60] - x[i * 60 : i * 60 + 60].mean(0)) ** 2).sum() for i in range(3))
        assert cost == pytest.approx(inner)
    assert vectors.silhouette(df, "v", "g") > 0.9
    assert vectors.davies_bouldin(df, "v", "g").first()["davies_bouldin"] < 0.2


def test_projection(blobs):
    df, x = blobs
    model = vectors.fit_pca(df, "v", 3)
    shares = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [s for _, s in vectors.explained_variance(model)] == pytest.approx(list(shares / shares.sum()))
    back = vectors.reconstruct(vectors.project(df, "v", model), model)
    assert back.select(F.max(vectors.distance("v", "rebuilt"))).first()[0] == pytest.approx(0, abs=1e-9)
    white = vectors.whiten(vectors.project(df, "v", model), k=3)
    got = white.select(F.stddev_samp(F.get("whitened", F.lit(2)))).first()[0]
    assert got == pytest.approx(1.0)


def test_shuffled_column_is_a_permutation(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    out = models.shuffled_column(df, "id", "v", block=60)
    assert out.count() == 500 and {r["v"] for r in out.collect()} == set(range(0, 1000, 2))
    assert out.filter("v = id * 2").count() < 60


def test_models_learn(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random(400), rng.random(400)
    data = [(i, float(p), float(q), float(p > 0.5), float(3 * p - q)) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "id int, a double, b double, y double, z double")
    ready = models.assemble(df, ["a", "b"])
    fit = models.linear_model(ready, "z", "ols")
    assert list(fit.coefficients) == pytest.approx([3, -1])
    assert abs(models.linear_model(ready, "z", "lasso", 10.0).coefficients[0]) < 1e-9
    tree = models.tree_model(ready, "y", "tree")
    lost = {r["feature"]: r["loss"] for r in models.permutation_importance(df, tree, ["a", "b"], "y", "id").collect()}
    assert lost["a"] > 0.3 and lost["b"] == pytest.approx(0, abs=0.02)
    curve = [r["mean"] for r in models.partial_dependence(df, tree, ["a", "b"], "a", [0.1, 0.9], "id").orderBy("at").collect()]
    assert curve == [0.0, 1.0]
    assert models.balance_weights(df, "y").groupBy("y").agg(F.sum("weight")).count() == 2
    assert models.resample(df, "y", "id", {1.0: 2.0}).filter("y = 1").count() == 2 * df.filter("y = 1").count()
    assert models.resample(df, "y", "id", {1.0: 0.0}).filter("y = 1").count() == 0


def test_davies_bouldin_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame(
        [(i % 7, [float(i % 7) * 3 + (i % 5) * 0.1, float((i % 7) ** 2) + (i % 3) * 0.2]) for i in range(70)], "g int, v array<double>"
    )
    whole = vectors.davies_bouldin(df, "v", "g").first()
    monkeypatch.setattr(vectors, "BLOCK", 2)
    cut = vectors.davies_bouldin(df, "v", "g").first()
    assert cut["n_clusters"] == 7 and abs(cut["davies_bouldin"] - whole["davies_bouldin"]) < 1e-12


def test_topics_of_words_are_a_table_and_part_the_subjects(spark):
    r = np.random.default_rng(1)
    subjects = [[f"{c}{i}" for i in range(20)] for c in "xy"]
    df = spark.createDataFrame([([subjects[d % 2][k] for k in r.integers(0, 20, 40)],) for d in range(600)] + [([],), (None,)], "w array<string>")
    drawn = lda.batches(df, "w", 30, 0)
    model = lda.fit(df.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("n")), drawn, df.count(),
                    lambda b: text.term_counts(b, "doc", "words"), 2, 30, 0)
    assert {x["term"] for x in model.collect()} == {w for s in subjects for w in s}
    told = text.topics(df, "w", k=2, terms=20, iterations=30).collect()
    for t in (0, 1):
        assert len({x["term"][0] for x in told if x["topic"] == t}) == 1
    assert sum(x["weight"] for x in told if x["topic"] == 0) > 0.8


def test_topics_bring_no_list_of_words_to_the_driver(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("the vocabulary is on the driver")

    monkeypatch.setattr("pyspark.ml.feature.CountVectorizer.fit", refuse)
    df = spark.createDataFrame([([f"w{i}", f"w{i + 1}"],) for i in range(200)], "w array<string>")
    assert {x["topic"] for x in text.topics(df, "w", k=3, terms=2, iterations=2).collect()} == {0, 1, 2}


def test_gamma_functions():
    x = np.array([0.01, 0.5, 1.0, 7.3])
    by_hand = [(lgamma(v * 1.0001) - lgamma(v * 0.9999)) / (v * 0.0002) for v in x]
    assert lda.digamma(x) == pytest.approx(by_hand, rel=1e-4)
    assert lda.trigamma(x) == pytest.approx((lda.digamma(x * 1.0001) - lda.digamma(x * 0.9999)) / (x * 0.0002), rel=1e-4)


def test_integer_keys_are_not_numbered(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("keys are numbered")

    monkeypatch.setattr(patterns, "dense_ids", refuse)
    data = [(-5 + 9 * u, (1 << 30) + i, float(1 + u % 3 + i % 2)) for u in range(12) for i in range(8) if (u + i) % 5]
    df = spark.createDataFrame([*data, (None, 1, 3.0)], "u long, i long, r double")
    model = patterns.factorize_keys(df, "u", "i", "r", rank=3, iterations=10)
    asked = spark.createDataFrame([*[(u, i) for u, i, _ in data], (1 << 40, 1 << 30), (4, 7), (None, None)], "u long, i long")
    told = model.predict(asked)
    got = {(x["u"], x["i"]): x["prediction"] for x in told.collect()}
    assert got[1 << 40, 1 << 30] is None and got[4, 7] is None and got[None, None] is None and told.count() == asked.count()
    assert np.sqrt(np.mean([(got[u, i] - r) ** 2 for u, i, r in data])) < 0.35


def test_pairs_are_moved_once_by_user_and_once_by_item(spark):
    df = spark.createDataFrame([(f"u{k % 7}", f"i{k % 5}", 1.0) for k in range(35)], "u string, i string, r double")
    told = patterns.factorize_keys(df, "u", "i", "r", rank=2, iterations=1).predict(df.hint("merge"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2 and all("#" in x for x in joins)


def test_blocks_follow_the_ratings():
    assert patterns._blocks(10) == {"numUserBlocks": 4, "numItemBlocks": 4}
    assert patterns._blocks(10 * patterns.BLOCK_RATINGS)["numUserBlocks"] == 10


def test_bootstrap_draws_as_by_hand_and_explodes_no_row(spark):
    data = [(None if i == 3 else i, None if i % 7 == 0 else "ab"[i % 2], None if i == 5 else i * 1.5) for i in range(40)]
    df = spark.createDataFrame(data, "id long, g string, v double").repartition(3)
    out = evaluate.bootstrap_mean(df, "v", "id", ["g"], replicates=10, level=0.8, seed=3)
    assert "Generate posexplode(sequence" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "MapInArrow" in plan
    # the longest task follows the number of tasks, not the number of files
    assert "Repartition 8, true" in evaluate.bootstrap_mean(df.coalesce(1), "v", "id")._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r for r in out.collect()}
    bounds = np.cumsum([np.exp(-1) / factorial(n) for n in range(12)])
    for g in ("a", "b"):
        rows = [(i, v) for i, x, v in data if x == g and v is not None]
        w = []
        for i, _ in rows:
            text = b"".join(md5(("" if i is None else f"{i}:").encode() + f"{d}:3".encode()).digest() for d in range(3))
            w.append([np.searchsorted(bounds, int.from_bytes(text[4 * r : 4 * r + 4], "big") / 2**32, side="right") for r in range(10)])
        w, v = np.array(w), np.array([v for _, v in rows])
        means = (w * v[:, None]).sum(axis=0) / w.sum(axis=0)
        assert got[g]["low"] == pytest.approx(np.quantile(means, 0.1)) and got[g]["std_error"] == pytest.approx(np.std(means, ddof=1))


def test_rows_are_split_once_for_all_fits(spark, monkeypatch):
    from rillstone.plans.catalog import QUERIES

    fit, plans = models.logistic, []

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(df, *rest)

    monkeypatch.setattr(models, "logistic", seen)
    got = QUERIES["logistic_balanced"](spark, SMALL).collect()
    assert len(got) == 6 and len(plans) == 3 and not any("md5" in p for p in plans)
