"""Frequent itemsets, rules, ordered patterns, recommendations, records in place and time."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from rillstone.functions.numbering import dense_ids
from rillstone.functions.runtime import cut_lineage, written


def _mined(df: DataFrame, basket: str, item: str, support: float) -> tuple[DataFrame, int]:
    """``members, n`` of the frequent sets of classes, and the number of baskets. Items of exactly the same baskets are a
    class, an array of ``members``; one of them is mined, so items that always come together make one set and not one for
    each of their combinations. An item below the support is in no frequent set, so a basket then holds at most
    (mean basket size / support) items however many rows its key has."""
    # the source is read once
    pairs = cut_lineage(df.select(F.col(basket).alias("_b"), F.col(item).alias("_i")).dropna().distinct())
    n_baskets = pairs.select("_b").distinct().count()
    least = max(1, ceil(support * n_baskets))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "_b")).alias(f"_m{seed}") for seed in (1, 2)]
    frequent = pairs.groupBy("_i").agg(F.count("*").alias("_n"), *marks).filter(F.col("_n") >= least)
    classes = cut_lineage(
        frequent.groupBy("_n", "_m1", "_m2").agg(F.array_sort(F.collect_list("_i")).alias("members"))
        .select(F.get("members", F.lit(0)).alias("_i"), "members")
    )
    baskets = cut_lineage(pairs.join(classes.select("_i"), "_i", "left_semi").groupBy("_b").agg(F.collect_set("_i").alias("items")))
    # Baskets without a frequent item are gone; the threshold must stay the same count.
    share = min(1.0, (least - 0.5) / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=0.0).fit(baskets)
    found = cut_lineage(model.freqItemsets.filter(F.col("freq") >= least).withColumn("_s", F.monotonically_increasing_id()))
    sets = found.select("_s", F.col("freq").alias("n"), F.explode("items").alias("_i")).join(classes, "_i")
    return sets.groupBy("_s", "n").agg(F.array_sort(F.collect_list("members")).alias("members")), n_baskets


#: Combinations that a row of a set gives out at once.
GIVEN = 1 << 16


def _itemsets(df: DataFrame, basket: str, item: str, support: float) -> tuple[DataFrame, int]:
    """Sorted item arrays with their counts, and the number of baskets. A set of classes stands for every choice of some
    members of each; choices are numbered and given out in parts."""
    sets, n_baskets = _mined(df, basket, item, support)
    choices = F.transform("members", lambda m: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(m)) - 1)
    total = F.aggregate(choices, F.lit(1).cast("bigint"), lambda x, y: x * y)
    numbered = sets.select("members", "n", choices.alias("_c"), total.alias("_total"))
    parts = numbered.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1, F.lit(GIVEN).cast("bigint"))))
    # rows are dealt before they become many
    dealt = parts.repartition("members", "_from")
    each = dealt.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + GIVEN, F.col("_total")) - 1)))
    before = F.transform("_c", lambda c, i: F.aggregate(F.slice("_c", 1, i), F.lit(1).cast("bigint"), lambda x, y: x * y))
    chosen = F.zip_with(
        "members", F.zip_with("_c", before, lambda c, b: F.floor(F.col("_k") / b) % c + 1),
        lambda m, mask: F.filter(m, lambda _, i: F.call_function("getbit", mask, i) == 1),
    )
    return each.select(F.array_sort(F.flatten(chosen)).alias("items"), "n"), n_baskets


def closed_itemsets(df: DataFrame, basket: str, item: str, support: float = 0.01) -> DataFrame:
    """``(itemset, size, n)`` of the frequent sets that no larger set has as many baskets as; every other frequent set is a
    part of one of them with the same count."""
    sets, _ = _mined(df, basket, item, support)
    keyed = cut_lineage(sets.select("members", "n"))
    one_less = keyed.filter(F.size("members") > 1).select(
        "n", F.explode(F.transform("members", lambda m: F.array_remove("members", m))).alias("members")
    ).groupBy("members").agg(F.max("n").alias("_larger"))
    kept = keyed.join(one_less, "members", "left").filter("_larger IS NULL OR _larger < n")
    items = F.array_sort(F.flatten("members"))
    return kept.select(items.alias("items"), "n").select(_joined("items").alias("itemset"), F.size("items").cast("long").alias("size"), "n")


def _joined(items: str) -> Column:
    return F.array_join(F.col(items).cast("array<string>"), ",")


def frequent_itemsets(df: DataFrame, basket: str, item: str, support: float = 0.01) -> DataFrame:
    """``(itemset, size, n)`` with the items sorted and joined by a comma."""
    sets, _ = _itemsets(df, basket, item, support)
    return sets.select(_joined("items").alias("itemset"), F.size("items").cast("long").alias("size"), "n")


def association_rules(
    df: DataFrame, basket: str, item: str, support: float = 0.01, confidence: float = 0.1
) -> DataFrame:
    """Rules with one item on the right: support, confidence, lift, conviction."""
    sets, total = _itemsets(df, basket, item, support)
    rules = sets.filter(F.size("items") > 1).select(
        "items", "n", F.explode("items").alias("right")
    ).withColumn("left", F.array_remove("items", F.col("right")))
    ante = sets.select(F.col("items").alias("left"), F.col("n").alias("_na"))
    cons = sets.filter(F.size("items") == 1).select(
        F.get("items", F.lit(0)).alias("right"), F.col("n").alias("_nc")
    )
    joined = rules.join(ante, "left").join(cons, "right")
    conf = F.col("n") / F.col("_na")
    share = F.col("_nc") / F.lit(total)
    return joined.filter(conf >= confidence).select(
        _joined("left").alias("antecedent"),
        F.col("right").cast("string").alias("consequent"),
        (F.col("n") / F.lit(total)).alias("support"),
        conf.alias("confidence"),
        (conf / share).alias("lift"),
        F.try_divide(1 - share, 1 - conf).alias("conviction"),
    )


def sequential_patterns(
    df: DataFrame, group: Sequence[str], item: str, time_col: str, support: float = 0.2, length: int = 4
) -> DataFrame:
    """Ordered patterns of at most ``length`` items: items of one instant are one step (``a+b``), later steps follow
    ``>``, and items may repeat. ``n`` counts the groups that hold the pattern. Infrequent items go first; of equal
    steps in a row ``length`` stay, since no pattern uses more of them. A group's steps make one sequence, so ``group``
    has to cut time where it would never end."""
    seen = df.select(*group, F.col(time_col).alias("_t"), F.col(item).cast("string").alias("_i")).dropna().distinct()
    total = df.select(*group).dropna().distinct().count()
    least = max(1, ceil(support * total))
    often = seen.groupBy("_i").agg(F.count_distinct(*group).alias("_n")).filter(F.col("_n") >= least)
    steps = seen.join(often.select("_i"), "_i", "left_semi").groupBy(*group, "_t").agg(
        F.array_sort(F.collect_list("_i")).alias("_s")
    )
    along = Window.partitionBy(*group).orderBy("_t")
    needed = steps.withColumn("_back", F.lag("_s", length).over(along))
    for back in range(1, length):
        needed = needed.withColumn("_back", F.when(F.lag("_s", back).over(along) == F.col("_s"), F.col("_back")))
    needed = needed.filter(~F.coalesce(F.col("_back") == F.col("_s"), F.lit(False)))
    entries = F.array_sort(F.collect_list(F.struct("_t", "_s")))
    rows = cut_lineage(needed.groupBy(*group).agg(F.transform(entries, lambda e: e["_s"]).alias("sequence")))
    # groups without a frequent item are gone; the threshold must stay the same count
    share = min(1.0, (least - 0.5) / max(1, rows.count()))
    span = PrefixSpan(minSupport=share, maxPatternLength=length, sequenceCol="sequence")
    found = span.findFrequentSequentialPatterns(rows).filter(F.col("freq") >= least)
    return found.select(
        F.array_join(F.transform("sequence", lambda s: F.array_join(F.array_sort(s), "+")), ">").alias("pattern"),
        F.size("sequence").cast("long").alias("length"),
        F.col("freq").alias("n"),
    )


def similar_items(
    ratings: DataFrame, seeds: DataFrame, user: str, item: str, rating: str, k: int = 10
) -> DataFrame:
    """The k items most alike (cosine over users) to each requested item. Only requested items
    meet the others, so a row is repeated at most once per seed and no user's items are paired
    with each other. ``seeds`` has one column named like ``item``."""
    slim = ratings.groupBy(user, item).agg(F.sum(rating).alias("_r"))
    norms = slim.groupBy(item).agg(F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("_norm"))
    mine = slim.join(seeds.select(item).distinct(), item, "left_semi").select(
        user, F.col(item).alias("seed"), F.col("_r").alias("_s")
    )
    dots = (
        slim.join(mine, user)
        .filter(F.col(item) != F.col("seed"))
        .groupBy("seed", item)
        .agg(F.sum(F.col("_r") * F.col("_s")).alias("_dot"), F.count("*").alias("n_users"))
    )
    seed_norm = norms.select(F.col(item).alias("seed"), F.col("_norm").alias("_seed_norm"))
    scored = (
        dots.join(norms, item)
        .join(seed_norm, "seed")
        .select("seed", item, "n_users", F.try_divide("_dot", F.col("_norm") * F.col("_seed_norm")).alias("cosine"))
    )
    best = Window.partitionBy("seed").orderBy(F.desc("cosine"), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def factorize(
    ratings: DataFrame, user: str, item: str, rating: str, rank: int = 8, iterations: int = 5, seed: int = 0, **options
):
    """Alternating least squares with Spark's blocked factors; unknown users get no prediction."""
    return ALS(
        userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=iterations, seed=seed,
        coldStartStrategy="drop", **options,
    ).fit(ratings)


MOST_IDS = 2**31 - 1
#: Ratings that one block of the solver holds, about.
BLOCK_RATINGS = 1 << 25


class Factors:
    """A factor model of users and items under keys of any type."""

    def __init__(self, users: DataFrame, items: DataFrame, user: str, item: str):
        self.users, self.items, self.user, self.item = users, items, user, item

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``prediction``; null for a user or an item that the model has not seen. Factors are put to the
        keys, of which there are few, so that pairs are moved once by user and once by item."""
        met = pairs.join(self.users, self.user, "left").join(self.items, self.item, "left")
        product = F.aggregate(F.zip_with("_p", "_q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        return met.select(*pairs.columns, F.when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), product).alias("prediction"))


def _blocks(n: int) -> dict:
    """Each step sends a factor to the blocks that rate with it, which is mostly all of them: no more blocks than keep
    each at ``BLOCK_RATINGS``, and a few for the cores."""
    blocks = max(4, ceil(n / BLOCK_RATINGS))
    return {"numUserBlocks": blocks, "numItemBlocks": blocks}


def _ids(df: DataFrame, *keys: str) -> tuple[int, bool]:
    """The number of rows, and whether all values of ``keys`` are integers that the solver takes as they are."""
    whole = all(isinstance(df.schema[k].dataType, (ByteType, ShortType, IntegerType, LongType)) for k in keys)
    ends = [f(F.col(k).cast("long")) for k in keys for f in (F.min, F.max)] if whole else []
    n, *ends = df.agg(F.count("*"), *ends).first()
    return n, whole and all(x is None or -MOST_IDS <= x <= MOST_IDS for x in ends)


def factorize_keys(
    ratings: DataFrame, user: str, item: str, rating: str, rank: int = 8, iterations: int = 5, seed: int = 0, **options
) -> Factors:
    """Alternating least squares for users and items with keys of any type. Integers that fit the solver's are taken as they
    are, other keys are numbered without holes. Ratings without a key or a value are left out; equal pairs count each."""
    known = ratings.select(user, item, rating).dropna()
    value = F.col(rating).cast("float").alias("_rating")
    n, whole = _ids(known, user, item)
    options = _blocks(n) | options
    if whole:
        model = factorize(known.select(F.col(user).cast("int").alias("_user"), F.col(item).cast("int").alias("_item"), value),
                          "_user", "_item", "_rating", rank, iterations, seed, **options)
        tables = [
            f.select(F.col("id").cast(known.schema[k].dataType).alias(k), F.col("features").alias(v))
            for f, k, v in ((model.userFactors, user, "_p"), (model.itemFactors, item, "_q"))
        ]
        return Factors(*tables, user, item)
    users = cut_lineage(dense_ids(known.select(user).distinct(), user, name="_user"))
    items = cut_lineage(dense_ids(known.select(item).distinct(), item, name="_item"))
    if max(users.count(), items.count()) > MOST_IDS:
        raise ValueError("the solver numbers at most 2^31 - 1 users and items")
    numbered = known.join(users, user).join(items, item).select(
        F.col("_user").cast("int").alias("_user"), F.col("_item").cast("int").alias("_item"), value
    )
    # the solver reads them several times
    model = factorize(written(numbered, "ratings"), "_user", "_item", "_rating", rank, iterations, seed, **options)
    mine = users.join(model.userFactors.select(F.col("id").alias("_user"), F.col("features").alias("_p")), "_user").drop("_user")
    theirs = items.join(model.itemFactors.select(F.col("id").alias("_item"), F.col("features").alias("_q")), "_item").drop("_item")
    return Factors(mine, theirs, user, item)


def commodity_filter(
    df: DataFrame, commodity_col: str, commodities: Sequence[str], state_col: str | None = None, states: Sequence[str] = ()
) -> DataFrame:
    """Records of the wanted commodities in the configured states; both lists reach the scan."""
    out = df.filter(F.col(commodity_col).isin(*commodities))
    return out.filter(F.col(state_col).isin(*states)) if state_col and states else out


def spatial_cells(
    df: DataFrame, lat: str, lon: str, size: float = 1.0, by: Sequence[str] = (), value: str | None = None
) -> DataFrame:
    """Records per square cell of latitude and longitude."""
    cell = {"cell_lat": F.floor(F.col(lat) / size), "cell_lon": F.floor(F.col(lon) / size)}
    stats = [F.count("*").alias("n"), F.avg(lat).alias("mean_lat"), F.avg(lon).alias("mean_lon")]
    if value:
        stats.append(F.avg(value).alias(f"mean_{value}"))
    return df.groupBy(*by, *[v.alias(k) for k, v in cell.items()]).agg(*stats)


def yearly_trend(df: DataFrame, time_col: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per year: records, mean, and change of the mean since the year before."""
    years = df.groupBy(*by, F.year(time_col).alias("year")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean")
    )
    along = Window.partitionBy(*(by or [F.lit(0)])).orderBy("year")
    return years.withColumn("change", F.col("mean") - F.lag("mean").over(along))
