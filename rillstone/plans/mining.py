"""Text, evaluation, privacy, patterns and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import rounded
from rillstone.functions.runtime import spread, written
from rillstone.operators import evaluate, patterns, privacy, text
from rillstone.plans.registry import Tables, query, r

TOKENS = r"""(select doc_id, case when s = '' then [] else string_split(s, ' ') end as words from
    (select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as s from documents))"""
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def words(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select(
        "doc_id", text.tokens("text").alias("words")
    )


@query("tokenize", f"select doc_id, len(words)::int as n, array_to_string(words, ' ') as words from {TOKENS}")
def tokenize(t: Tables) -> DataFrame:
    return words(t).select("doc_id", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))


@query(
    "remove_stopwords",
    f"""select doc_id, array_to_string(list_filter(words, lambda w: w not in ({STOP})), ' ') as words from {TOKENS}""",
)
def remove_stopwords(t: Tables) -> DataFrame:
    return words(t).select("doc_id", F.array_join(text.without_stopwords("words"), " ").alias("words"))


@query(
    "ngrams",
    f"""select words[i] || ' ' || words[i + 1] as ngram, count(*) as n from
        (select words, unnest(range(1, len(words))) as i from {TOKENS}) group by 1""",
)
def ngrams(t: Tables) -> DataFrame:
    return text.ngram_counts(words(t), "words", 2)


@query("bow", f"select doc_id, term, count(*) as n from (select doc_id, unnest(words) as term from {TOKENS}) group by 1, 2")
def bow(t: Tables) -> DataFrame:
    return text.term_counts(words(t), "doc_id", "words")


@query(
    "tfidf",
    f"""with b as (select doc_id, term, count(*) as n from (select doc_id, unnest(words) as term from {TOKENS}) group by 1, 2),
        d as (select term, count(*) as n_docs from b group by 1)
        select doc_id, term, n, n_docs, {r('n * ln(((select count(*) from documents) + 1.0) / (n_docs + 1.0))')} as tfidf
        from b join d using (term)""",
)
def tfidf(t: Tables) -> DataFrame:
    return rounded(text.tfidf(words(t), "doc_id", "words"))


def labelled_words(t: Tables) -> DataFrame:
    return words(t).join(t.labels, "doc_id").select(
        "doc_id", "words", F.col("quality").cast("double").alias("label")
    )


@query("text_classify")
def text_classify(t: Tables) -> DataFrame:
    """Two classifiers, trained on one hash split and measured on the other."""
    data = evaluate.hash_split(labelled_words(t), "doc_id")
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    out = None
    for kind in ("logistic", "bayes"):
        scored = text.fit_text_classifier(train, "words", "label", kind).transform(test)
        row = evaluate.classification_metrics(scored, "label", "prediction").select(
            F.lit(kind).alias("model"), "tp", "fp", "fn", "tn", "accuracy", "f1"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "text_bayes",
    f"""with s as (select doc_id, words, quality as label, ('0x' || substr(md5(doc_id || ':0'), 1, 15))::bigint < {int(0.8 * evaluate.HASH_RANGE)} as train
        from {TOKENS} join labels using (doc_id)),
      b as (select doc_id, label, train, term, count(*) as n from (select doc_id, label, train, unnest(words) as term from s) group by all),
      c as (select label, term, sum(n) as n from b where train group by 1, 2),
      m as (select label, ln(d / (select count(*) from s where train)) as prior, coalesce(total, 0) + (select count(distinct term) from c) as total
        from (select label, count(*) as d from s where train group by 1) left join (select label, sum(n) as total from c group by 1) using (label)),
      x as (select b.doc_id, m.label, sum(b.n * ln((coalesce(c.n, 0) + 1.0::double) / total)) as gain from b
        join (select distinct term from c) using (term) join m on true left join c on c.label = m.label and c.term = b.term where not b.train group by 1, 2),
      y as (select s.doc_id, m.label, prior + coalesce(gain, 0) as score from s join m on true left join x on x.doc_id = s.doc_id and x.label = m.label where not train)
      select doc_id, first(label order by score desc, label)::double as prediction, {r('max(score)')} as score from y group by 1""",
)
def text_bayes(t: Tables) -> DataFrame:
    """Bayes over all words, trained on one hash split and asked for the other."""
    data = evaluate.hash_split(labelled_words(t), "doc_id")
    model = text.fit_bayes(data.filter("split = 'train'"), "words", "label")
    return rounded(text.bayes_classify(data.filter("split = 'test'"), "doc_id", "words", model))


@query("word2vec")
def word2vec(t: Tables) -> DataFrame:
    return text.word_vectors(words(t), "words", size=16)


@query("lda_topics")
def lda_topics(t: Tables) -> DataFrame:
    clean = words(t).select(text.without_stopwords("words").alias("words"))
    return text.topics(clean, "words", k=4, iterations=5)


# --- scores ----------------------------------------------------------------------------------

# A score from the length of a text, with ties, and the verdict at one half.
SCORED = """(select doc_id, lang, source, quality, toxic, least((n_chars // 40) / 100.0::double, 1.0::double) as score,
    case when n_chars >= 2000 then 1 else 0 end as predicted from documents join labels using (doc_id))"""


def scored(t: Tables) -> DataFrame:
    score = F.least(F.floor(F.col("n_chars") / 40) / 100.0, F.lit(1.0))
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", score.alias("score"),
        (F.col("n_chars") >= 2000).cast("int").alias("predicted"),
    )


_TICKET = "('0x' || substr(md5(event_id || ':{s}'), 1, 15))::bigint"


@query(
    "hash_split",
    f"""select event_id, value, case when {_TICKET.format(s=0)} < {int(0.8 * evaluate.HASH_RANGE)} then 'train' else 'test' end as split
        from events""",
)
def hash_split(t: Tables) -> DataFrame:
    return evaluate.hash_split(t.events.select("event_id", "value"), "event_id")


@query("kfold", f"select event_id, ({_TICKET.format(s=7)} % 5)::int as fold from events")
def kfold(t: Tables) -> DataFrame:
    return evaluate.kfold(t.events.select("event_id"), "event_id", 5, seed=7)


@query(
    "stratified_split",
    f"""select event_id, event_type, case when row_number() over (partition by event_type order by {_TICKET.format(s=0)})
        <= floor(count(*) over (partition by event_type) * 0.8) then 'train' else 'test' end as split from events""",
)
def stratified_split(t: Tables) -> DataFrame:
    return evaluate.stratified_split(t.events.select("event_id", "event_type"), "event_id", "event_type")


def _poisson_sql(u: str) -> str:
    """Poisson(1) draws, as the case of the sums of its probabilities."""
    term, total, out = 2.718281828459045**-1, 0.0, "case"
    for n in range(12):
        total += term
        out += f" when {u} < {total!r}::double then {n}"
        term /= n + 1
    return out + " else 12 end"


@query(
    "bootstrap_ci",
    f"""with d as (select event_type, value, d, md5(event_id || ':' || d || ':0') as h from events, (select unnest(range(0, 50)) as d) where value is not null),
      u as (select event_type, value, d * 4 + p as r, ('0x' || substr(h, p * 8 + 1, 8))::bigint / 4294967296.0::double as u
        from d, (select unnest([0, 1, 2, 3]) as p)),
      m as (select event_type, r, sum(w * value) / sum(w) as m from (select *, {_poisson_sql('u')} as w from u) group by 1, 2),
      i as (select event_type, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high, stddev_samp(m) as std_error from m group by 1)
      select event_type, count(value) as n, {r('avg(value)', 6)} as mean, {r('min(low)', 6)} as low, {r('min(high)', 6)} as high,
        {r('min(std_error)', 6)} as std_error from events join i using (event_type) group by 1""",
)
def bootstrap_ci(t: Tables) -> DataFrame:
    df = t.events.select("event_id", "event_type", "value")
    return rounded(evaluate.bootstrap_mean(df, "value", "event_id", ["event_type"]), 6)


@query(
    "regression_metrics",
    f"""with p as (select l_extendedprice as y, l_quantity * 1500.0 as f from lineitem)
        select count(*) as n, {r('avg((y - f) * (y - f)) / 1e6')} as mse, {r('sqrt(avg((y - f) * (y - f)))', 3)} as rmse,
        {r('avg(abs(y - f))', 3)} as mae, {r('1 - avg((y - f) * (y - f)) / var_pop(y)')} as r2 from p""",
)
def regression_metrics(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("guess"))
    m = evaluate.regression_metrics(df, "l_extendedprice", "guess")
    return m.select(
        "n",
        (F.round(F.col("mse") / 1e6, 4)).alias("mse"),
        F.round("rmse", 3).alias("rmse"),
        F.round("mae", 3).alias("mae"),
        F.round("r2", 4).alias("r2"),
    )


_CELLS = """count(*) filter (where quality = 1 and predicted = 1) as tp, count(*) filter (where quality <> 1 and predicted = 1) as fp,
    count(*) filter (where quality = 1 and predicted <> 1) as fn, count(*) filter (where quality <> 1 and predicted <> 1) as tn"""


@query(
    "classification_metrics",
    f"""with c as (select {_CELLS} from {SCORED}) select *, {r('(tp + tn) / (tp + fp + fn + tn)')} as accuracy,
        {r('tp / nullif(tp + fp, 0)')} as precision, {r('tp / nullif(tp + fn, 0)')} as recall,
        {r('2 * tp / nullif(2 * tp + fp + fn, 0)')} as f1 from c""",
)
def classification_metrics(t: Tables) -> DataFrame:
    return rounded(evaluate.classification_metrics(scored(t), "quality", "predicted"))


@query("confusion_matrix", f"select quality, predicted, count(*) as n from {SCORED} group by 1, 2")
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluate.confusion_matrix(scored(t), "quality", "predicted")


_CURVE = f"""with s as (select score, count(*) filter (where quality = 1) as pos, count(*) filter (where quality <> 1) as neg
      from {SCORED} group by 1),
    c as (select *, sum(pos) over (order by score desc) as cp, sum(neg) over (order by score desc) as cn from s)"""


@query("roc_curve", f"""{_CURVE} select score, {r('cp / (select sum(pos) from s)')} as tpr, {r('cn / (select sum(neg) from s)')} as fpr from c""")
def roc_curve(t: Tables) -> DataFrame:
    return rounded(evaluate.roc_curve(scored(t), "score", "quality"))


@query(
    "roc_auc",
    f"""{_CURVE} select sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg,
        {r('sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg))', 6)} as roc_auc from c""",
)
def roc_auc(t: Tables) -> DataFrame:
    return rounded(evaluate.roc_auc(scored(t), "score", "quality"), 6)


@query("pr_auc", f"""{_CURVE} select sum(pos)::bigint as n_pos, {r('sum(pos * cp / (cp + cn)) / sum(pos)', 6)} as average_precision from c""")
def pr_auc(t: Tables) -> DataFrame:
    return rounded(evaluate.pr_auc(scored(t), "score", "quality"), 6)


@query(
    "binned_roc_auc",
    f"""{_CURVE.replace('score, count', 'least(floor(score * 20), 19) as score, count')} select sum(pos)::bigint as n_pos,
        sum(neg)::bigint as n_neg, {r('sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg))', 6)} as roc_auc from c""",
)
def binned_roc_auc(t: Tables) -> DataFrame:
    return rounded(evaluate.binned_roc_auc(scored(t), "score", "quality", 20), 6)


@query(
    "calibration",
    f"""select least(floor(score * 10), 9)::int as bin, count(*) as n, {r('avg(score)', 6)} as mean_score, {r('avg(quality)', 6)} as rate
        from {SCORED} group by 1""",
)
def calibration(t: Tables) -> DataFrame:
    return rounded(evaluate.calibration(scored(t), "score", "quality"), 6)


@query(
    "precision_at_k",
    f"""select lang, count(*) as n, {r('avg((quality = 1)::int)', 6)} as precision_at_k from
        (select *, row_number() over (partition by lang order by score desc, doc_id) as rn from {SCORED}) where rn <= 20 group by 1""",
)
def precision_at_k(t: Tables) -> DataFrame:
    return rounded(evaluate.precision_at_k(scored(t), "score", "quality", 20, ["lang"], "doc_id"), 6)


@query(
    "map_ndcg_at_k",
    f"""with a as (select *, row_number() over (partition by source order by score desc, doc_id) as rn,
          row_number() over (partition by source order by quality desc, doc_id) as gn from {SCORED}),
        h as (select *, sum(quality) over (partition by source order by rn) as hits from a where rn <= 10),
        s as (select source, sum(quality * hits / rn) as ap, sum(quality / log2(rn + 1)) as dcg from h group by 1),
        b as (select source, sum(quality / log2(gn + 1)) as ideal, count(*) filter (where quality > 0) as possible from a where gn <= 10 group by 1)
        select count(*) as n_groups, {r('avg(coalesce(ap / nullif(possible, 0), 0))', 6)} as map_at_k,
          {r('avg(coalesce(dcg / nullif(ideal, 0), 0))', 6)} as ndcg_at_k from s join b using (source)""",
)
def map_ndcg_at_k(t: Tables) -> DataFrame:
    return rounded(evaluate.mean_ranking_metrics(scored(t), "source", "score", "quality", 10, "doc_id"), 6)


_FAIR = f"""with c as (select lang, count(*) as n, {_CELLS} from {SCORED} group by lang),
    f as (select lang, n, (tp + fp) / n as selection_rate, tp / nullif(tp + fn, 0) as tpr, fp / nullif(fp + tn, 0) as fpr,
      tp / nullif(tp + fp, 0) as precision from c)"""


@query(
    "fairness_audit",
    f"""{_FAIR} select lang, n, {r('selection_rate', 6)} as selection_rate, {r('tpr', 6)} as tpr, {r('fpr', 6)} as fpr,
        {r('precision', 6)} as precision from f""",
)
def fairness_audit(t: Tables) -> DataFrame:
    return rounded(evaluate.fairness_by_group(scored(t), "quality", "predicted", "lang"), 6)


@query(
    "fairness_gaps",
    f"""{_FAIR} select {r('max(selection_rate) - min(selection_rate)', 6)} as demographic_parity_gap,
        {r('greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))', 6)} as equalized_odds_gap,
        {r('max(precision) - min(precision)', 6)} as calibration_gap,
        {r('min(selection_rate) / max(selection_rate)', 6)} as disparate_impact from f""",
)
def fairness_gaps(t: Tables) -> DataFrame:
    return rounded(evaluate.fairness_gaps(scored(t), "quality", "predicted", "lang"), 6)


@query(
    "fairness_calibration",
    f"""select lang, least(floor(score * 4), 3)::int as bin, count(*) as n, {r('avg(score)', 6)} as mean_score,
        {r('avg(quality)', 6)} as rate from {SCORED} group by 1, 2""",
)
def fairness_calibration(t: Tables) -> DataFrame:
    return rounded(evaluate.calibration(scored(t), "score", "quality", 4, ["lang"]), 6)


_MID = "timestamp '2024-01-16 00:00:00'"


@query(
    "drift_psi",
    f"""with q as (select quantile_cont(value, [{', '.join(str(i / 10) for i in range(1, 10))}]) as cuts from events where ts < {_MID}),
      b as (select len(list_filter(cuts, lambda e: e < value))::int as bin, ts < {_MID} as early from events, q),
      c as (select bin, count(*) filter (where early) as n_before, count(*) filter (where not early) as n_after from b group by 1),
      s as (select *, greatest(n_before / sum(n_before) over (), 1e-6) as p, greatest(n_after / sum(n_after) over (), 1e-6) as q from c)
      select bin, n_before, n_after, {r('(q - p) * ln(q / p)', 8)} as psi from s
      union all select null, sum(n_before)::bigint, sum(n_after)::bigint, {r('sum((q - p) * ln(q / p))', 8)} from s""",
)
def drift_psi(t: Tables) -> DataFrame:
    early = t.events.filter("ts < timestamp_ntz'2024-01-16 00:00:00'")
    late = t.events.filter("ts >= timestamp_ntz'2024-01-16 00:00:00'")
    return rounded(evaluate.drift_psi(early, late, "value"), 8)


# --- privacy ---------------------------------------------------------------------------------


@query(
    "k_anonymity",
    """select min(n) as k, count(*) as n_classes, count(*) filter (where n < 5) as n_small_classes,
       coalesce(sum(n) filter (where n < 5), 0)::bigint as n_exposed_rows from
       (select c_nationkey, c_mktsegment, floor(c_acctbal / 2000) as band, count(*) as n from customer group by 1, 2, 3)""",
)
def k_anonymity(t: Tables) -> DataFrame:
    df = t.customer.withColumn("band", F.floor(F.col("c_acctbal") / 2000))
    return privacy.k_anonymity(df, ["c_nationkey", "c_mktsegment", "band"], 5)


@query(
    "l_diversity",
    "select c_nationkey, count(*) as n, count(distinct c_mktsegment) as l from customer group by 1",
)
def l_diversity(t: Tables) -> DataFrame:
    return privacy.l_diversity(t.customer, ["c_nationkey"], "c_mktsegment")


_U = "((('0x' || substr(md5(c_mktsegment || ':0'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0 - 0.5)"


@query(
    "dp_count",
    f"""select c_mktsegment, {r(f'count(*) - sign({_U}) * ln(1 - 2 * abs({_U})) / 0.5', 6)} as noisy_count
        from customer group by 1""",
)
def dp_count(t: Tables) -> DataFrame:
    return rounded(privacy.dp_count(t.customer, ["c_mktsegment"], epsilon=0.5, seed="0"), 6)


# --- patterns --------------------------------------------------------------------------------

BASKETS = "(select distinct l_orderkey as o, p_brand as b from lineitem join part on p_partkey = l_partkey)"
_SETS = f"""n as (select count(distinct o) as n from {BASKETS}),
    one as (select b, count(*) as n from {BASKETS} group by 1),
    two as (select x.b as a, y.b as b, count(*) as n from {BASKETS} x join {BASKETS} y on x.o = y.o and x.b < y.b group by 1, 2),
    three as (select x.b as a, y.b as b, z.b as c, count(*) as n from {BASKETS} x join {BASKETS} y on x.o = y.o and x.b < y.b
      join {BASKETS} z on x.o = z.o and y.b < z.b group by 1, 2, 3),
    sets as (select b as itemset, 1::bigint as size, one.n from one, n where one.n >= 0.01 * n.n
      union all select a || ',' || b, 2, two.n from two, n where two.n >= 0.01 * n.n
      union all select a || ',' || b || ',' || c, 3, three.n from three, n where three.n >= 0.01 * n.n)"""


def baskets(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("brand")
    )


@query("frequent_itemsets", f"with {_SETS} select itemset, size, n from sets")
def frequent_itemsets(t: Tables) -> DataFrame:
    """At this support no four brands are frequent, which the SQL relies on."""
    return patterns.frequent_itemsets(baskets(t), "basket", "brand", 0.01)


@query(
    "closed_itemsets",
    f"""with {_SETS}, larger as (select itemset, max(n) as n from (
        select a as itemset, n from two union all select b, n from two union all select a || ',' || b, n from three
        union all select a || ',' || c, n from three union all select b || ',' || c, n from three) group by 1)
      select s.itemset, size, s.n from sets s left join larger l on l.itemset = s.itemset where l.n is null or l.n < s.n""",
)
def closed_itemsets(t: Tables) -> DataFrame:
    """Frequent sets that are not part of a larger one with the same count."""
    return patterns.closed_itemsets(baskets(t), "basket", "brand", 0.01)


@query(
    "association_rules",
    f"""with {_SETS}, dir as (select a as l, b as r, n from two union all select b, a, n from two
        union all select b || ',' || c, a, n from three union all select a || ',' || c, b, n from three
        union all select a || ',' || b, c, n from three)
      select d.l as antecedent, d.r as consequent, {r('d.n / n.n', 6)} as support, {r('d.n / x.n', 6)} as confidence,
        {r('(d.n / x.n) / (y.n / n.n)', 6)} as lift, {r('(1 - y.n / n.n) / nullif(1 - d.n / x.n, 0)', 6)} as conviction
      from dir d join sets x on x.itemset = d.l join sets y on y.itemset = d.r, n
      where d.n >= 0.01 * n.n and d.n / x.n >= 0.12""",
)
def association_rules(t: Tables) -> DataFrame:
    return rounded(patterns.association_rules(baskets(t), "basket", "brand", 0.01, 0.12), 6)


@query(
    "sequential_patterns",
    """with f as (select distinct user_id as u, cast(ts as date) as d, event_type as e, ts as t from events),
        g as (select count(*) as n from (select distinct u, d from f)),
        two as (select a.u, a.d, a.e || case when a.t = b.t then '+' else '>' end || b.e as p, b.t, b.e, case when a.t = b.t then 1 else 2 end as l
          from f a join f b on a.u = b.u and a.d = b.d and (a.t < b.t or (a.t = b.t and a.e < b.e))),
        three as (select x.u, x.d, x.p || case when x.t = c.t then '+' else '>' end || c.e as p, case when x.t = c.t then x.l else x.l + 1 end as l
          from two x join f c on x.u = c.u and x.d = c.d and (x.t < c.t or (x.t = c.t and x.e < c.e))),
        p as (select u, d, e as p, 1 as l from f union select u, d, p, l from two union select u, d, p, l from three)
        select p as pattern, l::bigint as length, count(*) as n from p group by 1, 2 having count(*) >= (select ceil(0.02 * n) from g)""",
)
def sequential_patterns(t: Tables) -> DataFrame:
    df = t.events.withColumn("day", F.to_date("ts"))
    return patterns.sequential_patterns(df, ["user_id", "day"], "event_type", "ts", 0.02, 3)


def ratings(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating")
    )


@query(
    "item_similarity",
    f"""with r as (select o_custkey as u, l_partkey as i, sum(l_quantity) as r from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
      nrm as (select i, sqrt(sum(r * r)) as norm from r group by 1),
      seeds as (select i from (select l_partkey as i, sum(l_quantity) as q from lineitem group by 1 order by q desc, i limit 5)),
      d as (select s.i as seed, o.i as item, sum(s.r * o.r) as dot, count(*) as n_users from r s join r o on o.u = s.u and o.i <> s.i
        where s.i in (select i from seeds) group by 1, 2),
      c as (select seed, item, n_users, round(dot / (a.norm * b.norm), 10) as cosine from d join nrm a on a.i = d.seed join nrm b on b.i = d.item)
      select seed, item, n_users, {r('cosine', 6)} as cosine, rank from (select *, row_number() over (partition by seed order by cosine desc, item)::int as rank from c) where rank <= 10""",
)
def item_similarity(t: Tables) -> DataFrame:
    """Items like the five best sellers."""
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("q"))
    seeds = sold.orderBy(F.desc("q"), "item").limit(5)
    return rounded(patterns.similar_items(ratings(t), seeds, "user", "item", "rating"), 6)


@query("als")
def als(t: Tables) -> DataFrame:
    """Fit on one hash split of the ratings; error on both, and how many pairs the model knows nothing of."""
    df = ratings(t).withColumn("pair", F.concat_ws("-", "user", "item"))
    return _fit_and_errors(evaluate.hash_split(df, "pair"))


def _fit_and_errors(df: DataFrame) -> DataFrame:
    """Fit and scores read the rows several times: they are joined and split once."""
    df = written(df.drop("pair"), "ratings")
    model = patterns.factorize_keys(df.filter("split = 'train'"), "user", "item", "rating")
    return _errors(model.predict(df))


def _errors(told: DataFrame) -> DataFrame:
    return rounded(
        told.groupBy("split").agg(
            F.count("*").alias("n"), F.count_if(F.col("prediction").isNull()).alias("n_unknown"),
            F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"),
        )
    )


@query("als_text_keys")
def als_text_keys(t: Tables) -> DataFrame:
    """The same for users and items that are known by text and by numbers that fit no integer."""
    df = ratings(t).select(
        F.concat(F.lit("customer "), "user").alias("user"), (F.col("item") + F.lit(1 << 40)).alias("item"), "rating",
        F.concat_ws("-", "user", "item").alias("pair"),
    )
    return _fit_and_errors(evaluate.hash_split(df, "pair"))


@query(
    "commodity_filter",
    """select p_partkey, p_name, p_brand, p_type from part where p_type in ('LARGE', 'PROMO')
       and p_brand in ('Brand#1', 'Brand#2', 'Brand#11')""",
)
def commodity_filter(t: Tables) -> DataFrame:
    kept = patterns.commodity_filter(
        t.part, "p_type", ["LARGE", "PROMO"], "p_brand", ["Brand#1", "Brand#2", "Brand#11"]
    )
    return kept.select("p_partkey", "p_name", "p_brand", "p_type")


@query(
    "spatial_cells",
    f"""select floor(c_acctbal / 100.0 / 5)::bigint as cell_lat, floor(c_nationkey * 7.0 / 5)::bigint as cell_lon, count(*) as n,
        {r('avg(c_acctbal / 100.0)', 6)} as mean_lat, {r('avg(c_nationkey * 7.0)', 6)} as mean_lon from customer group by 1, 2""",
)
def spatial_cells(t: Tables) -> DataFrame:
    df = t.customer.select((F.col("c_acctbal") / 100.0).alias("lat"), (F.col("c_nationkey") * 7.0).alias("lon"))
    return rounded(patterns.spatial_cells(df, "lat", "lon", 5.0), 6)


@query(
    "yearly_trend",
    f"""with y as (select o_orderstatus, year(o_orderdate)::int as year, count(*) as n, avg(o_totalprice) as mean from orders group by 1, 2)
        select o_orderstatus, year, n, {r('mean', 6)} as mean, {r('mean - lag(mean) over (partition by o_orderstatus order by year)', 6)} as change from y""",
)
def yearly_trend(t: Tables) -> DataFrame:
    return rounded(patterns.yearly_trend(t.orders, "o_orderdate", "o_totalprice", ["o_orderstatus"]), 6)
