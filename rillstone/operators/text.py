"""Text cleaning, term counts, TF-IDF, and models on text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.runtime import cut_lineage
from rillstone.operators import lda, skipgram

# Common English words that carry little meaning.
STOPWORDS = (
    "a about after all also an and any are as at be been but by can could did do does for from had "
    "has have he her him his how i if in into is it its just may me more most my no not of on one "
    "only or other our out over s she so some such t than that the their them then there these they "
    "this to up was we were what when which who will with would you your"
).split()


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, in one pass of one pattern."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def without_stopwords(words: str | Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    c = F.col(words) if isinstance(words, str) else words
    return F.filter(c, lambda w: ~w.isin(*stopwords))


def ngrams(words: str | Column, n: int = 2) -> Column:
    """Runs of ``n`` words, built by joining the list with its own shifts."""
    c = F.col(words) if isinstance(words, str) else words
    if n < 1:
        raise ValueError("n must be at least 1")
    size = F.size(c) - (n - 1)
    out = F.slice(c, 1, F.greatest(size, F.lit(0)))
    for shift in range(1, n):
        part = F.slice(c, shift + 1, F.greatest(size, F.lit(0)))
        out = F.zip_with(out, part, lambda a, b: F.concat_ws(" ", a, b))
    return out


def term_counts(df: DataFrame, key: str, words: str) -> DataFrame:
    """Bag of words in long form, one row of ``df`` being one document. All words of a document
    are in one row, so runs of the sorted list are counted there and nothing is shuffled."""
    listed = df.select(key, F.sort_array(words).alias("_w"))
    changed = F.transform(
        "_w", lambda w, i: F.when((i == 0) | (w != F.get("_w", F.greatest(i - 1, F.lit(0)))), i)
    )
    starts = listed.select(key, "_w", F.array_compact(changed).alias("_a"))
    ends = F.concat(F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(0))), F.array(F.size("_w")))
    runs = F.zip_with(
        "_a", ends, lambda a, b: F.struct(F.get("_w", a).alias("term"), (b - a).cast("bigint").alias("n"))
    )
    # No filter on the list: it would be pushed down and the words made a second time there.
    return starts.select(key, F.inline(F.when(F.size("_a") > 0, runs)))


def ngram_counts(df: DataFrame, words: str, n: int = 2) -> DataFrame:
    return df.select(F.explode(ngrams(words, n)).alias("ngram")).groupBy("ngram").agg(
        F.count("*").alias("n")
    )


def tfidf(df: DataFrame, key: str, words: str) -> DataFrame:
    """Term count times ``ln((N + 1) / (df + 1))``. A word in most documents is one hot join key:
    the side of document counts has one row per term and is broadcast by Spark when measured
    small, else adaptive execution splits the hot partition."""
    counts = term_counts(df, key, words)
    spread = counts.groupBy("term").agg(F.count("*").alias("n_docs"))
    total = df.select(F.count("*")).scalar()
    idf = F.log((total + 1.0) / (F.col("n_docs") + 1.0))
    return counts.join(spread, "term").select(
        key, "term", "n", "n_docs", (F.col("n") * idf).alias("tfidf")
    )


def fit_text_classifier(
    train: DataFrame, words: str, label: str, kind: str = "logistic", features: int = 1 << 14
) -> PipelineModel:
    """Hashed TF-IDF and a linear model. Hashing keeps the feature width fixed."""
    stages = [HashingTF(inputCol=words, outputCol="_tf", numFeatures=features)]
    if kind == "logistic":
        stages += [
            IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(labelCol=label, maxIter=20, regParam=0.01),
        ]
    elif kind == "bayes":
        stages += [NaiveBayes(featuresCol="_tf", labelCol=label)]
    else:
        raise ValueError("kind is 'logistic' or 'bayes'")
    return Pipeline(stages=stages).fit(train)


def fit_bayes(train: DataFrame, words: str, label: str, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial Bayes over all words, in joins and aggregates: ``term, gains`` with a gain for each label that has the
    word, and ``labels``, one row with an array of every label's prior and of the logarithm that a known word has there
    without having been seen. All words of the training rows count."""
    known = train.filter(F.col(label).isNotNull())
    seen = known.select(F.col(label).alias("_label"), F.explode(words).alias("term")).groupBy("_label", "term").agg(F.count("*").alias("_n"))
    seen = cut_lineage(seen)
    size = seen.select(F.count_distinct("term")).scalar()
    docs = known.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_docs"))
    totals = seen.groupBy("_label").agg(F.sum("_n").alias("_total"))
    total = F.coalesce("_total", F.lit(0)) + F.lit(smoothing) * size
    each = cut_lineage(docs.join(totals, "_label", "left").select(
        "_label", F.log(F.col("_docs") / known.select(F.count("*")).scalar()).alias("prior"), F.log(smoothing / total).alias("rest")
    ))
    labels = each.agg(F.array_sort(F.collect_list(F.struct(F.col("_label").alias("label"), "prior", "rest"))).alias("labels"))
    gain = F.log((F.col("_n") + smoothing) / smoothing)
    terms = seen.groupBy("term").agg(F.collect_list(F.struct(F.col("_label").alias("label"), gain.alias("gain"))).alias("gains"))
    return terms, labels


def bayes_classify(df: DataFrame, key: str, words: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``key, prediction, score`` of every row: the label of the largest logarithm, the smaller of equals. Words that were
    not trained on count for nothing; a row without known words goes by the priors."""
    terms, labels = model
    counts = term_counts(df, key, words).join(terms, "term")
    each = counts.select(key, "n", "gains", F.posexplode("gains").alias("_i", "g"))
    sums = each.groupBy(key, F.col("g.label").alias("_label")).agg(
        F.sum(F.col("n") * F.col("g.gain")).alias("_gain"), F.sum(F.when(F.col("_i") == 0, F.col("n")).otherwise(0)).alias("_first")
    )
    per = sums.groupBy(key).agg(F.sum("_first").alias("_known"), F.collect_list(F.struct("_label", "_gain")).alias("_gains"))
    told = df.select(key).join(per, key, "left").withColumn("_labels", labels.scalar())

    def score(x: Column) -> Column:
        own = F.filter("_gains", lambda g: g["_label"] == x["label"])
        gain = F.coalesce(F.try_element_at(own, F.lit(1)).getField("_gain"), F.lit(0.0))
        return x["prior"] + F.coalesce("_known", F.lit(0)) * x["rest"] + gain

    scored = F.transform("_labels", lambda x: F.struct((-score(x)).alias("less"), x["label"].alias("label")))
    best = told.select(key, F.array_min(scored).alias("_b"))
    return best.select(key, F.col("_b.label").alias("prediction"), (-F.col("_b.less")).alias("score"))


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("string")


def word_vectors(
    df: DataFrame, words: str, size: int = 32, min_count: int = 5, buckets: int | None = None, seed: int = 0,
    partitions: int = 8,
) -> DataFrame:
    """``(word, vector)`` for every word with ``min_count`` uses, each with a vector of its own (``skipgram``). The model holds two
    vectors for each of these words; ``buckets``, off unless it is given, bounds it by learning vectors of so many hashes
    of words, which words of one hash then share. Text is trained in ``partitions`` parts, a parameter, so that the
    cluster's size does not change the number of parts."""
    trained, name = df.select(F.col(words).alias("_words")), F.col("word")
    if buckets:
        trained, name = df.select(F.transform(words, lambda w: _bucket(w, buckets)).alias("_words")), _bucket(F.col("word"), buckets)
    # a bucket is used at least as often as each of its words
    vectors = skipgram.fit(trained, "_words", size, min_count, seed, partitions)
    if not buckets:
        return vectors
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= min_count).select("word", name.alias("_name"))
    return often.join(vectors.withColumnRenamed("word", "_name"), "_name").select("word", "vector")


def topics(
    df: DataFrame, words: str, k: int = 5, terms: int = 8, buckets: int | None = None, seed: int = 0, iterations: int = 10
) -> DataFrame:
    """``(topic, rank, term, weight)`` of a latent Dirichlet model over all words (``lda``); equal weights come by
    frequency. The model is a table with ``k`` weights for each word; ``buckets``, off unless it is given, bounds it by counting so many hashes of words
    instead, each named by its most used word, the first of equals."""
    listed = df.select((F.transform(words, lambda w: _bucket(w, buckets)) if buckets else F.col(words)).alias("_words"))
    used = listed.select(F.explode("_words").alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    drawn = lda.batches(listed, "_words", iterations, seed)
    model = lda.fit(used, drawn, df.count(), lambda batch: term_counts(batch, "doc", "words"), k, iterations, seed)
    total = F.array(*(F.lit(float(x)) for x in lda.column_sums(model, k)))
    each = model.select("term", "n", F.posexplode("weights").alias("topic", "_w")).withColumn("weight", F.col("_w") / F.get(total, "topic"))
    along = Window.partitionBy("topic").orderBy(F.desc("weight"), F.desc("n"), "term")
    told = each.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= terms).select("topic", "rank", "term", "weight")
    if not buckets:
        return told
    told = told.withColumnRenamed("term", "_bucket")
    spelt = df.select(F.explode(words).alias("w")).withColumn("_bucket", _bucket(F.col("w"), buckets))
    spelt = spelt.join(told.select("_bucket").distinct(), "_bucket", "left_semi").groupBy("_bucket", "w").agg((-F.count("*")).alias("_n"))
    names = spelt.groupBy("_bucket").agg(F.min_by("w", F.struct("_n", "w")).alias("term"))
    return told.join(names, "_bucket").select("topic", "rank", "term", "weight")
