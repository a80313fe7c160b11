"""Filtering pages by rules on host and path, and by associations of URL parts that Spark's FP-growth finds.

Rules name a host and a path. Where none fits, the method judges: URLs that a rule has judged are the labelled ones;
their tokens and the label make one basket each, FP-growth finds the frequent combinations, and those that imply a
label with enough support and confidence are kept, without longer ones that are no more certain. Kept rules are
an inverted index from token to rule; a URL's tokens are joined with it, and the rules of which all tokens are there vote
with their confidence. All steps are DataFrame operations.

Defined cases: a null URL and one without ``://`` have an empty host and path, fit no rule and have no tokens. A URL that
no rule of either kind fits gets the more frequent label of the labelled URLs, or ``allow`` if there are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.statistics import join_statistics
from rillstone.llm.blocks import written

LABELS = ("allow", "block")
#: The rules of the contract, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def tokens(url: Column) -> Column:
    """What a URL is made of: scheme, labels of the host, the host's name without its first label, path parts with
    numbers as one sign, the ending, names of query fields, and whether it has a fragment."""
    host = host_of(url)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    site = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    parts = F.transform(
        F.filter(F.split(path_of(url), "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")),
    )
    fields = F.transform(
        F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1)),
    )
    more = F.array(
        F.concat(F.lit("site:"), site), F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    every = F.array_distinct(F.concat(labels, parts, fields, F.array_compact(more)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def token_classes(labelled: DataFrame, support: float) -> DataFrame:
    """``token, class, sure``: the frequent tokens of ``labelled(items, verdict)``. Tokens that stand in exactly the same
    baskets are a class, named by the smallest; ``sure`` is the label that all baskets of the class have, if they do."""
    baskets = labelled.withColumn("_basket", F.monotonically_increasing_id())
    least = F.lit(support) * labelled.count()
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "_basket")).alias(f"_m{seed}") for seed in (1, 2)]
    each = baskets.select("_basket", "verdict", F.explode("items").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), *marks,
        F.when(F.min("verdict") == F.max("verdict"), F.min("verdict")).alias("sure"),
    ).filter(F.col("n") >= least)
    named = each.groupBy("n", "_m1", "_m2").agg(F.min("token").alias("class"))
    return each.join(named, ["n", "_m1", "_m2"]).select("token", "class", "sure", "n")


def mine(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """``rule, parts, label, confidence, support`` from ``labelled(items, verdict)``, and ``token, class`` of the tokens
    that parts stand for. Nothing is mined that could not become a rule: of tokens with the same baskets one is, since
    a rule with two of them is no more certain than with one, and tokens that make a label certain are rules by
    themselves."""
    total = labelled.count()
    tokens_of = written(token_classes(labelled, support), "tokens")
    label = F.concat(F.lit("label:"), F.col("verdict"))
    open_tokens = tokens_of.filter("token = class AND sure IS NULL").select("token")
    numbered = written(labelled.withColumn("_basket", F.monotonically_increasing_id()), "baskets")
    kept = numbered.select("_basket", F.explode("items").alias("token")).join(open_tokens, "token", "left_semi")
    lists = kept.groupBy("_basket").agg(F.collect_set("token").alias("_open"))
    baskets = numbered.join(lists, "_basket", "left").select(
        F.concat(F.coalesce("_open", F.array().cast("array<string>")), F.array(label)).alias("items")
    )
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    rules = found.filter(F.col("consequent")[0].startswith("label:")).filter(
        ~F.exists("antecedent", lambda x: x.startswith("label:"))
    ).select(
        F.array_sort("antecedent").alias("parts"), F.substring(F.col("consequent")[0], 7, 100).alias("label"), "confidence", "support"
    ).unionByName(
        tokens_of.filter("token = class AND sure IS NOT NULL").select(
            F.array("token").alias("parts"), F.col("sure").alias("label"), F.lit(1.0).alias("confidence"),
            (F.col("n") / F.lit(float(max(1, total)))).alias("support"),
        )
    )
    rules = written(rules.withColumn("rule", F.xxhash64("parts", "label")), "rules")
    # a longer rule goes if one with a part less is as certain
    shorter = rules.select(F.col("rule").alias("_long"), "label", "confidence", F.explode("parts").alias("_part"), "parts").select(
        "_long", "confidence", F.xxhash64(F.array_remove("parts", F.col("_part")), "label").alias("rule")
    )
    worse = shorter.join(rules.select("rule", F.col("confidence").alias("_sure")), "rule").filter("_sure >= confidence")
    return rules.join(worse.select(F.col("_long").alias("rule")).distinct(), "rule", "left_anti"), tokens_of.select("token", "class")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, support: float = 0.01, confidence: float = 0.6
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages(page_id, url)``; score is the share of
    the votes that say block, null where a given rule has judged. A rule votes once for each choice of one token
    of the URL for each of its parts."""
    url = F.col("url").cast("string")
    read = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    read = read.withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("items", tokens(F.col("url")))
    read = read.withColumn("_list", F.md5(F.to_json("items").cast("binary")))
    known = read.filter("_m IS NOT NULL").select("items", F.col("_m.verdict").alias("verdict"))
    votes = {r["verdict"]: r["n"] for r in known.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    default = max(LABELS, key=lambda x: votes.get(x, 0))
    if not votes:
        return _out(read.withColumn("score", F.lit(None).cast("double")), default)
    kept, classes = mine(known, support, confidence)
    kept = written(kept, "kept")
    index = kept.select("rule", "label", "confidence", F.size("parts").alias("_size"), F.explode("parts").alias("class"))
    # equal lists of tokens are judged once
    lists = read.filter("_m IS NULL AND size(items) > 0").groupBy("_list").agg(F.first("items").alias("items"))
    parts = lists.select("_list", F.explode("items").alias("token")).join(classes, "token").groupBy("_list", "class").agg(
        F.count("*").cast("double").alias("_choices")
    )
    hits = parts.join(index, "class").groupBy("_list", "rule", "label", "confidence", "_size").agg(
        F.count("*").alias("_met"), F.product("_choices").alias("_votes")
    ).filter("_met = _size")
    vote = F.col("confidence") * F.col("_votes")
    scored = hits.groupBy("_list").agg(
        (F.sum(F.when(F.col("label") == "block", vote).otherwise(0.0)) / F.sum(vote)).alias("score")
    )
    # pages stay where they are unless there are very many different lists
    return _out(join_statistics(read, scored, ["_list"], "left"), default)


def _out(read: DataFrame, default: str) -> DataFrame:
    by_method = F.when(F.col("score") > 0.5, F.lit("block")).when(F.col("score") < 0.5, F.lit("allow")).otherwise(F.lit(default))
    return read.select(
        "page_id", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce("_m.verdict", by_method).alias("verdict"),
        F.when(F.col("_m").isNull(), F.col("score")).alias("score"),
    )
