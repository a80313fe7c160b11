"""Clusters, outliers, projections, models and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import rounded
from rillstone.functions.runtime import scratch_path, spread, written
from rillstone.operators import density, evaluate, least_squares, models, neighbors, vectors
from rillstone.plans.elimination import eliminate, normal_sums
from rillstone.plans.registry import Tables, query, r
from rillstone.streaming import daily as stream

# Customers as points in the plane: balance and mean order value, both in thousands.
PLANE = """(select c_custkey as id, c_acctbal / 1000 as x, avg(o_totalprice) / 10000 as y from customer
    join orders on o_custkey = c_custkey group by 1, 2)"""


def plane(t: Tables) -> DataFrame:
    mean = t.orders.groupBy("o_custkey").agg((F.avg("o_totalprice") / 10000).alias("y"))
    return t.customer.join(mean, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x"), "y"
    )


_NEAR = f"""p as {PLANE}, d as (select a.id, b.id as other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance
    from p a join p b on a.id <> b.id),
  n as (select * from d qualify row_number() over (partition by id order by distance, other) <= 10)"""


@query(
    "lof",
    f"""with {_NEAR}, kd as (select id, max(distance) as k_distance from n group by 1),
      l as (select n.id, 10 / sum(greatest(distance, k_distance)) as lrd from n join kd on kd.id = n.other group by 1)
      select n.id, {r('min(k.k_distance)')} as k_distance, {r('avg(o.lrd) / min(m.lrd)')} as lof
      from n join l o on o.id = n.other join l m on m.id = n.id join kd k on k.id = n.id group by 1""",
)
def lof(t: Tables) -> DataFrame:
    return rounded(neighbors.local_outlier_factor(plane(t), "id", ["x", "y"], 10))


@query("isolation_forest")
def isolation_forest(t: Tables) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return neighbors.isolation_forest(spread(t.lineitem.select(key.alias("id"), *columns)), "id", columns)


_EPS = 0.35


@query(
    "dbscan",
    f"""with recursive p as {PLANE}, e as (select a.id as u, b.id as v from p a join p b on
          (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {_EPS} * {_EPS}),
        core as (select u as id from e group by u having count(*) >= 6),
        ce as (select u, v from e where u in (select id from core) and v in (select id from core)),
        reach(id, root) as (select id, id from core union select ce.v, reach.root from reach join ce on ce.u = reach.id where reach.root < ce.v),
        comp as (select id, min(root) as cluster from reach group by 1),
        border as (select e.u as id, min(cluster) as cluster from e join comp on comp.id = e.v
          where e.u not in (select id from core) group by 1)
        select p.id, coalesce(comp.cluster, border.cluster) as cluster, comp.id is not null as is_core
        from p left join comp on comp.id = p.id left join border on border.id = p.id""",
)
def dbscan(t: Tables) -> DataFrame:
    return density.dbscan(plane(t), "id", "x", "y", _EPS, 6)


@query(
    "knn_classify",
    f"""with p as {PLANE}, b as (select p.*, c_mktsegment as label, md5(p.id || ':0') as h from p join customer on c_custkey = p.id),
      s as (select *, ('0x' || substr(h, 1, 15))::bigint < {int(0.8 * evaluate.HASH_RANGE)} as train from b),
      d as (select q.id, o.label, o.id as other, sqrt((q.x - o.x) ** 2 + (q.y - o.y) ** 2) as distance from s q join s o on not q.train and o.train),
      n as (select * from d qualify row_number() over (partition by id order by distance, other) <= 5),
      v as (select id, label, count(*) as c from n group by 1, 2)
      select id, first(label order by c desc, label) as prediction from v group by 1""",
)
def knn_classify(t: Tables) -> DataFrame:
    data = plane(t).join(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), "id"
    )
    data = evaluate.hash_split(data, "id")
    return neighbors.knn_classify(
        data.filter("split = 'train'"), data.filter("split = 'test'"), "id", ["x", "y"], "label", 5
    )




@query(
    "pairwise_distance",
    f"""with f as (select vec_id, label, embedding::double[] as v from embeddings),
      x as (select vec_id, label, unnest(v) as a, unnest(range(1, len(v) + 1)) as i from f),
      c as (select label, i, avg(a) as b from x group by 1, 2)
      select vec_id, x.label, {r('sqrt(sum((a - b) ** 2))', 5)} as euclidean, {r('sum(abs(a - b))', 5)} as manhattan,
        {r('1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))', 5)} as cosine
      from x join c on c.label = x.label and c.i = x.i group by 1, 2""",
)
def pairwise_distance(t: Tables) -> DataFrame:
    """Each vector against the centre of its label."""
    middle = vectors.centroids(t.embeddings, "embedding", "label").select(
        "label", F.col("centroid").alias("embedding")
    )
    pairs = t.embeddings.select("vec_id", "label")
    left = t.embeddings.select("vec_id", "embedding")
    return rounded(vectors.pairwise_distance(pairs, left, middle, "vec_id", "label", "embedding"), 5)


def _clusters(t: Tables, made: tuple[DataFrame, float]) -> DataFrame:
    rows, cost = made
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.lit(cost).alias("inertia"))


@query("kmeans")
def kmeans(t: Tables) -> DataFrame:
    return _clusters(t, vectors.kmeans(t.embeddings, "embedding", 10))


@query("bisecting_kmeans")
def bisecting_kmeans(t: Tables) -> DataFrame:
    return _clusters(t, vectors.bisecting_kmeans(t.embeddings, "embedding", 10))


@query(
    "silhouette",
    f"""with f as (select vec_id, label, embedding::double[] as v from embeddings),
      x as (select vec_id, label, unnest(v) as a, unnest(range(1, len(v) + 1)) as i from f),
      s as (select label, i, sum(a) as sa, count(*) as n from x group by 1, 2),
      q as (select label, sum(a * a) as sq from x group by 1),
      m as (select label, max(n) as n from s group by 1),
      dots as (select x.vec_id, x.label, s.label as other, sum(x.a * s.sa) as dot, sum(x.a * x.a) as own from x join s on s.i = x.i group by 1, 2, 3),
      d as (select vec_id, dots.label, other, (n * own + sq - 2 * dot) / (n - case when dots.label = other then 1 else 0 end) as mean
        from dots join q on q.label = other join m on m.label = other),
      ab as (select vec_id, max(mean) filter (where label = other) as a, min(mean) filter (where label <> other) as b from d group by 1)
      select {r('avg((b - a) / greatest(a, b))', 5)} as silhouette from ab""",
)
def silhouette(t: Tables) -> DataFrame:
    """The labels taken as clusters."""
    value = vectors.silhouette(t.embeddings, "embedding", "label")
    return rounded(t.embeddings.agg(F.max(F.lit(value)).alias("silhouette")), 5)


@query(
    "davies_bouldin",
    f"""with f as (select vec_id, label, embedding::double[] as v from embeddings),
      x as (select vec_id, label, unnest(v) as a, unnest(range(1, len(v) + 1)) as i from f),
      c as (select label, i, avg(a) as b from x group by 1, 2),
      e as (select vec_id, x.label, sqrt(sum((a - b) ** 2)) as d from x join c on c.label = x.label and c.i = x.i group by 1, 2),
      s as (select label, avg(d) as s from e group by 1),
      m as (select p.label as l, q.label as k, sqrt(sum((p.b - q.b) ** 2)) as m from c p join c q on p.i = q.i and p.label <> q.label group by 1, 2),
      w as (select l, max((s1.s + s2.s) / m) as r from m join s s1 on s1.label = l join s s2 on s2.label = k group by 1)
      select {r('avg(r)', 5)} as davies_bouldin, count(*) as n_clusters from w""",
)
def davies_bouldin(t: Tables) -> DataFrame:
    return rounded(vectors.davies_bouldin(t.embeddings, "embedding", "label"), 5)


@query("pca")
def pca(t: Tables) -> DataFrame:
    """Explained variance, with the spread of each projected and whitened component and the error
    of rebuilding the vectors from all of them."""
    k = 8
    model = vectors.fit_pca(t.embeddings, "embedding", k)
    table = t.spark.createDataFrame(
        vectors.explained_variance(model), "component int, explained double"
    )
    flat = vectors.whiten(vectors.project(t.embeddings, "embedding", model), k=k)
    spread = flat.select(F.posexplode("whitened").alias("i", "w"), "projected").groupBy(
        (F.col("i") + 1).alias("component")
    ).agg(F.stddev_samp("w").alias("whitened_std"), F.stddev_samp(F.get("projected", F.col("i"))).alias("std"))
    return table.join(spread, "component")


@query("pca_reconstruction")
def pca_reconstruction(t: Tables) -> DataFrame:
    model = vectors.fit_pca(t.embeddings, "embedding", 16)
    back = vectors.reconstruct(vectors.project(t.embeddings, "embedding", model), model)
    return back.select("vec_id", vectors.distance("embedding", "rebuilt").alias("error"))


# --- models ----------------------------------------------------------------------------------

LINE = ["l_quantity", "l_discount", "l_tax"]


def line(t: Tables) -> DataFrame:
    df = t.lineitem.withColumns(
        {
            "key": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"),
            "label": (F.col("l_extendedprice") > 50000).cast("double"),
        }
    )
    return evaluate.hash_split(df.select("key", "label", "l_extendedprice", *LINE), "key")


def vecs(t: Tables) -> DataFrame:
    return evaluate.hash_split(vectors.with_vector(t.embeddings, "embedding"), "vec_id")


def _accuracy(scored: DataFrame, label: str, name: str) -> DataFrame:
    hit = (F.col("prediction") == F.col(label)).cast("double")
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).select(
        F.lit(name).alias("model"), "split", "n", "accuracy"
    )


@query(
    "ols",
    f"""select l_returnflag, regr_count(l_extendedprice, l_quantity)::bigint as n, {r('regr_slope(l_extendedprice, l_quantity)')} as slope,
        {r('regr_intercept(l_extendedprice, l_quantity)')} as intercept, {r('regr_r2(l_extendedprice, l_quantity)', 6)} as r2
        from lineitem group by 1""",
)
def ols(t: Tables) -> DataFrame:
    fit = models.simple_ols(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6)})


_LINE_SQL = "(select *, l_quantity::double as q, l_discount::double as d, l_tax::double as t, l_extendedprice::double as y from lineitem)"


def _by_flag(penalty: float) -> str:
    parts = ", ".join(f"{r(f'b_{i}', 3)} as {c}" for i, c in enumerate(("intercept", "quantity", "discount", "tax")))
    return f"""with n as (select l_returnflag, {normal_sums('y', ['q', 'd', 't'], penalty)}, count(*) as n from {_LINE_SQL} group by 1),
      {eliminate('n', ['l_returnflag'], 4, kept=['n'])} select l_returnflag, n, {parts} from g"""


def _flag_fit(t: Tables, penalty: float) -> DataFrame:
    xs = ["l_quantity", "l_discount", "l_tax"]
    df = t.lineitem.select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in [*xs, "l_extendedprice"]])
    fit = least_squares.grouped_least_squares(df, ["l_returnflag"], "l_extendedprice", xs, penalty)
    names = ("intercept", "quantity", "discount", "tax")
    return rounded(fit.select("l_returnflag", "n", *(F.get("coef", F.lit(i)).alias(c) for i, c in enumerate(names))), 3)


@query("ols_by_group", _by_flag(0.0))
def ols_by_group(t: Tables) -> DataFrame:
    """Several columns, one regression for each group, in one aggregate."""
    return _flag_fit(t, 0.0)


@query("ridge_by_group", _by_flag(50.0))
def ridge_by_group(t: Tables) -> DataFrame:
    return _flag_fit(t, 50.0)


@query("linear_models")
def linear_models(t: Tables) -> DataFrame:
    """OLS, ridge and lasso weights on the training rows, and OLS on squares and products."""
    train = models.assemble(line(t).filter("split = 'train'"), LINE)
    out = None
    for kind in ("ols", "ridge", "lasso"):
        fit = models.linear_model(train, "l_extendedprice", kind, strength=100.0)
        part = models.coefficient_table(train, LINE, fit, kind)
        out = part if out is None else out.unionByName(part)
    wide = models.polynomial(train, 2)
    fit = models.linear_model(wide, "l_extendedprice", "ols", features="poly")
    names = [f"poly{i}" for i in range(len(fit.coefficients))]
    crossed = models.interaction(train, ["l_quantity", "l_discount"])
    both = models.linear_model(crossed, "l_extendedprice", "ols", features="crossed")
    return out.unionByName(models.coefficient_table(train, names, fit, "polynomial")).unionByName(
        models.coefficient_table(train, ["l_quantity:l_discount"], both, "interaction")
    )


@query("logistic_balanced")
def logistic_balanced(t: Tables) -> DataFrame:
    """Logistic regression plain, with class weights, and on resampled rows."""
    # all fits and scores read the rows many times: they are split and labelled once
    every = written(models.assemble(line(t), LINE).select("key", "label", "split", "features"), "line")
    train = every.filter("split = 'train'")
    fits = {
        "plain": models.logistic(train, "label"),
        "weighted": models.logistic(models.balance_weights(train, "label"), "label", "weight"),
        "resampled": models.logistic(models.resample(train, "label", "key", {1.0: 1.5, 0.0: 0.75}), "label"),
    }
    out = None
    for name, fit in fits.items():
        m = evaluate.classification_metrics(fit.transform(every), "label", "prediction", ["split"])
        row = m.select(F.lit(name).alias("model"), "split", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


@query("linear_svm")
def linear_svm(t: Tables) -> DataFrame:
    data = vecs(t).withColumn("y", (F.col("label") < 5).cast("double"))
    fit = models.linear_svm(data.filter("split = 'train'"), "y")
    return _accuracy(fit.transform(data), "y", "linear_svm")


@query("mlp")
def mlp(t: Tables) -> DataFrame:
    data = vecs(t).withColumn("y", F.col("label").cast("double"))
    fit = models.perceptron(data.filter("split = 'train'"), "y", [64, 24, 10])
    return _accuracy(fit.transform(data), "y", "mlp")


def _trees(t: Tables, kind: str) -> DataFrame:
    data = models.assemble(line(t), LINE)
    fit = models.tree_model(data.filter("split = 'train'"), "label", kind, depth=4, trees=10)
    shown = models.importance_table(data, LINE, fit).select(
        F.lit(kind).alias("model"), F.concat(F.lit("importance:"), "feature").alias("what"), F.col("importance").alias("value")
    )
    scored = _accuracy(fit.transform(data), "label", kind)
    return shown.unionByName(
        scored.select("model", F.concat(F.lit("accuracy:"), "split").alias("what"), F.col("accuracy").alias("value"))
    )


query("decision_tree")(lambda t: _trees(t, "tree"))
query("random_forest")(lambda t: _trees(t, "forest"))
query("gradient_boosting")(lambda t: _trees(t, "boosting"))


@query("permutation_importance")
def permutation_importance(t: Tables) -> DataFrame:
    data = line(t)
    fit = models.tree_model(models.assemble(data.filter("split = 'train'"), LINE), "label", "tree")
    return models.permutation_importance(data.filter("split = 'test'"), fit, LINE, "label", "key")


@query("partial_dependence")
def partial_dependence(t: Tables) -> DataFrame:
    data = line(t)
    fit = models.tree_model(models.assemble(data.filter("split = 'train'"), LINE), "label", "tree")
    return models.partial_dependence(data, fit, LINE, "l_quantity", [1, 10, 20, 30, 40, 50], "key")


# --- stream ----------------------------------------------------------------------------------


@query(
    "streaming_daily",
    f"""select event_type as site_no, cast(ts as date)::timestamp as date, {r('avg(value)', 6)} as value_mean,
        max(value) as value_max, min(value) as value_min from events
        where cast(ts as date) + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1, 2""",
)
def streaming_daily(t: Tables) -> DataFrame:
    """All event files through a stream; equals the batch days that the watermark has closed."""
    schema = t.events.schema
    readings = stream.reading_stream(t.spark, t.path("events"), schema).select(
        F.col("event_type").alias("site_no"), F.col("ts").alias("time"), "value", "event_id"
    )
    days = stream.daily_stream(readings, ["value"], reading_key=["event_id"])
    path = scratch_path(t.spark, "streaming_daily")
    return rounded(stream.drain(days, f"{path}/table", f"{path}/state"), 6)
