"""Joins, reshaping, distributions and series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import rounded
from rillstone.operators import features, relational, timeseries
from rillstone.plans.elimination import eliminate, normal_sums
from rillstone.plans.registry import Tables, query, r

# All customers against all orders. The orders' key is moved on, so both sides have keys the other lacks.
_JOIN_SQL = """select k as custkey, c_name, o_orderkey, o_totalprice from
    (select c_custkey as k, c_name from customer) {how} join
    (select o_custkey + 40 as k, o_orderkey, o_totalprice from orders) using (k)"""


def _join(t: Tables, how: str) -> DataFrame:
    left = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    right = t.orders.select((F.col("o_custkey") + 40).alias("custkey"), "o_orderkey", "o_totalprice")
    return relational.merge(left, right, "custkey", how)


for _how in relational.JOINS:
    query(f"join_{_how}", _JOIN_SQL.format(how=_how))(lambda t, how=_how: _join(t, how))


@query(
    "merge_all",
    """select c_custkey as custkey, c_name, n, spent, days from customer
       join (select o_custkey, count(*) as n from orders group by 1) a on a.o_custkey = c_custkey
       join (select o_custkey, round(sum(o_totalprice), 2) as spent from orders where o_orderstatus = 'F' group by 1) b on b.o_custkey = c_custkey
       join (select o_custkey, count(distinct o_orderdate) as days from orders group by 1) d on d.o_custkey = c_custkey""",
)
def merge_all(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "custkey")
    return relational.merge_all(
        [
            t.customer.select(F.col("c_custkey").alias("custkey"), "c_name"),
            orders.groupBy("custkey").agg(F.count("*").alias("n")),
            orders.filter("o_orderstatus = 'F'")
            .groupBy("custkey")
            .agg(F.round(F.sum("o_totalprice"), 2).alias("spent")),
            orders.groupBy("custkey").agg(F.count_distinct("o_orderdate").alias("days")),
        ],
        "custkey",
    )


@query(
    "melt_wide",
    """select l_orderkey, l_linenumber, 'l_quantity' as variable, l_quantity as value from lineitem
       union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem
       union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""",
)
def melt_wide(t: Tables) -> DataFrame:
    return relational.melt(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(
    "pivot_long",
    """select l_suppkey, sum(case when l_returnflag = 'A' then l_quantity end) as "A",
       sum(case when l_returnflag = 'N' then l_quantity end) as "N",
       sum(case when l_returnflag = 'R' then l_quantity end) as "R" from lineitem group by 1""",
)
def pivot_long(t: Tables) -> DataFrame:
    return relational.pivot(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])


_HOLES = """(select c_mktsegment, case when c_acctbal < 0 then null else c_acctbal end as c_acctbal,
    nullif(c_nationkey, 3) as c_nationkey, c_name from customer)"""


def _holes(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_mktsegment",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"),
        "c_name",
    )


def _missing_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return " union all ".join(
        f"""select {g}count(*) as n_rows, '{c}' as "column", count(*) - count({c}) as n_missing,
        {r(f'(count(*) - count({c})) / count(*)')} as share from {_HOLES}{tail}"""
        for c in ["c_acctbal", "c_nationkey", "c_name"]
    )


@query("missingness_profile", _missing_sql(""))
def missingness_profile(t: Tables) -> DataFrame:
    return rounded(relational.missingness_profile(_holes(t), ["c_acctbal", "c_nationkey", "c_name"]))


@query("missingness_by_group", _missing_sql("c_mktsegment"))
def missingness_by_group(t: Tables) -> DataFrame:
    return rounded(
        relational.missingness_profile(_holes(t), ["c_acctbal", "c_nationkey", "c_name"], ["c_mktsegment"])
    )


_FENCES = """(select event_type, min(value) as low, quantile_cont(value, 0.25) as q1, median(value) as median,
    quantile_cont(value, 0.75) as q3, max(value) as high from events group by 1)"""


@query(
    "boxplot_numbers",
    f"""select event_type, {r('low')} as low, {r('q1')} as q1, {r('median')} as median, {r('q3')} as q3, {r('high')} as high,
        {r('q1 - 1.5 * (q3 - q1)')} as lower_fence, {r('q3 + 1.5 * (q3 - q1)')} as upper_fence from {_FENCES}""",
)
def boxplot_numbers(t: Tables) -> DataFrame:
    return rounded(relational.five_numbers(t.events, "value", ["event_type"]))


@query(
    "iqr_outliers",
    f"""select event_id, event_type, value, {r('q1 - 1.5 * (q3 - q1)')} as lower_fence,
        {r('q3 + 1.5 * (q3 - q1)')} as upper_fence from events join {_FENCES} using (event_type)
        where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""",
)
def iqr_outliers(t: Tables) -> DataFrame:
    df = t.events.select("event_id", "event_type", "value")
    return rounded(relational.iqr_outliers(df, "value", ["event_type"]))


# Cubic feet per second to other units of flow, by market segment as unit name.
UNITS = {"AUTOMOBILE": 0.0283168, "BUILDING": 1.0, "FURNITURE": 448.831, "HOUSEHOLD": 28.3168}


@query(
    "unit_convert",
    f"""select c_custkey, c_mktsegment, {r('c_acctbal * f', 6)} as converted from customer left join (values
        {', '.join(f"('{k}', {v}::double)" for k, v in UNITS.items())}) u(s, f) on s = c_mktsegment""",
)
def unit_convert(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    out = relational.convert_units(df, "c_acctbal", "c_mktsegment", UNITS, "converted")
    return rounded(out.drop("c_acctbal"), 6)


@query(
    "histogram",
    f"""with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
        b as (select least(floor((l_extendedprice - lo) * 20 / (hi - lo))::int, 19) as bin, lo, hi from lineitem, e)
        select bin, {r('min(lo) + (min(hi) - min(lo)) / 20 * bin', 3)} as bin_start,
        {r('min(lo) + (min(hi) - min(lo)) / 20 * (bin + 1)', 3)} as bin_end, count(*) as n from b group by bin""",
)
def histogram(t: Tables) -> DataFrame:
    return rounded(relational.histogram(t.lineitem, "l_extendedprice", 20), 3)


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    " union all ".join(
        f"select '{a}' as x, '{b}' as y, {r(f'corr({a}, {b})', 6)} as r from lineitem"
        for i, a in enumerate(_CORR)
        for b in _CORR[i + 1 :]
    ),
)
def correlation_matrix(t: Tables) -> DataFrame:
    return rounded(relational.correlation_matrix(t.lineitem, _CORR), 6)


_SCALE = {
    "standard": ("avg({c})", "stddev_samp({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
}


def _scale_sql(kind: str) -> str:
    a, b = _SCALE[kind]
    parts = [f"{a.format(c=c)} as {c}_a, {b.format(c=c)} as {c}_b" for c in ["p_size", "p_retailprice"]]
    outs = [f"{r(f'({c} - {c}_a) / nullif({c}_b, 0)')} as {c}_scaled" for c in ["p_size", "p_retailprice"]]
    return f"select p_partkey, {', '.join(outs)} from part, (select {', '.join(parts)} from part)"


for _kind in _SCALE:
    query(f"scale_features_{_kind}", _scale_sql(_kind))(
        lambda t, kind=_kind: rounded(
            relational.scale_features(t.part, ["p_size", "p_retailprice"], kind).select(
                "p_partkey", "p_size_scaled", "p_retailprice_scaled"
            )
        )
    )


# --- series ----------------------------------------------------------------------------------


@query(
    "robust_z",
    f"""with m as (select event_type, median(value) as m from events group by 1),
        d as (select event_type, median(abs(value - m)) as mad from events join m using (event_type) group by 1)
        select event_id, event_type, value, {r('0.6745::double * (value - m) / nullif(mad, 0)', 8)} as robust_z
        from events join m using (event_type) join d using (event_type)""",
)
def robust_z(t: Tables) -> DataFrame:
    df = t.events.select("event_id", "event_type", "value")
    return df.transform(lambda x: timeseries.robust_z(x, "value", ["event_type"])).withColumn(
        "robust_z", F.round("robust_z", 8) + F.lit(0.0)
    )


SPEND = """(select o_orderpriority as site_no, o_orderdate as date, ln(sum(o_totalprice)) as x from orders group by 1, 2)"""

# Order days on a full calendar, so that rows are evenly spaced.
SPEND_SPINE = f"""spend as (select s.site_no, s.date, coalesce(p.x, 0) as x from
    (select site_no, unnest(generate_series(min(date), max(date), interval 1 day)) as date from {SPEND} group by 1) s
    left join {SPEND} p on p.site_no = s.site_no and p.date = s.date)"""


def spend(t: Tables) -> DataFrame:
    days = t.orders.groupBy(
        F.col("o_orderpriority").alias("site_no"), F.col("o_orderdate").alias("date")
    ).agg(F.log(F.sum("o_totalprice")).alias("x"))
    full = features.day_spine(days, ["site_no"], "date", ["x"])
    return full.withColumn("x", F.coalesce("x", F.lit(0.0)))


@query(
    "seasonal_decompose",
    f"""with {SPEND_SPINE},
      b as (select *, case when count(x) over c = 7 then avg(x) over c end as trend,
        ((row_number() over (partition by site_no order by date)) - 1) % 7 as phase from spend
        window c as (partition by site_no order by date rows between 3 preceding and 3 following)),
      p as (select site_no, phase, avg(x - trend) as p from b group by 1, 2),
      s as (select site_no, phase, p - avg(p) over (partition by site_no) as seasonal from p)
      select b.site_no, date, {r('x')} as x, {r('trend')} as trend, b.phase::int as phase, {r("seasonal")} as seasonal,
        {r('x - trend - seasonal')} as residual from b join s on s.site_no = b.site_no and s.phase = b.phase""",
)
def seasonal_decompose(t: Tables) -> DataFrame:
    return rounded(timeseries.seasonal_decompose(spend(t), "x", ["site_no"], "date"))


_DAY = """sum(x) over (partition by site_no order by date rows between 12 preceding and 12 following)
      - (lag(x, 12) over w + lead(x, 12) over w) / 2"""


def _season(source: str, trend: str, width: int, period: int, names: str) -> str:
    """Trend and season of one period as three tables."""
    t, p, s = (f"{names}_{k}" for k in "tps")
    return f"""{t} as (select *, case when count(x) over (partition by site_no order by date rows between {width} preceding and {width} following)
        = {2 * width + 1} then ({trend}) / {period} end as trend, (row_number() over w - 1) % {period} as phase from {source}
        window w as (partition by site_no order by date)),
      {p} as (select site_no, phase, avg(x - trend) as p from {t} group by 1, 2),
      {s} as (select site_no, phase, p - avg(p) over (partition by site_no) as seasonal from {p})"""


@query(
    "seasonal_decompose_even",
    f"""with {SPEND_SPINE}, {_season('spend', _DAY, 12, 24, 'a')}
      select b.site_no, date, {r('x')} as x, {r('trend')} as trend, b.phase::int as phase, {r("seasonal")} as seasonal,
        {r('x - trend - seasonal')} as residual from a_t b join a_s s on s.site_no = b.site_no and s.phase = b.phase""",
)
def seasonal_decompose_even(t: Tables) -> DataFrame:
    """An even period, as that of readings of a day."""
    return rounded(timeseries.seasonal_decompose(spend(t), "x", ["site_no"], "date", 24))


@query(
    "seasonal_decompose_two",
    f"""with {SPEND_SPINE},
      {_season('spend', 'sum(x) over (partition by site_no order by date rows between 3 preceding and 3 following)', 3, 7, 'a')},
      rest as (select b.site_no, date, x as whole, seasonal as seasonal_7, x - seasonal as x
        from a_t b join a_s s on s.site_no = b.site_no and s.phase = b.phase),
      {_season('rest', _DAY, 12, 24, 'd')}
      select b.site_no, date, {r('whole')} as x, {r('trend')} as trend, {r('seasonal_7')} as seasonal_7, {r('seasonal')} as seasonal_24,
        {r('x - seasonal - trend')} as residual from d_t b join d_s s on s.site_no = b.site_no and s.phase = b.phase""",
)
def seasonal_decompose_two(t: Tables) -> DataFrame:
    """Two seasons, one after the other."""
    return rounded(timeseries.seasonal_decompose(spend(t), "x", ["site_no"], "date", [7, 24]))


@query(
    "dickey_fuller",
    f"""with {SPEND_SPINE}, s as (select site_no, x - lag(x) over w as y, lag(x) over w as l from spend
        window w as (partition by site_no order by date)),
      f as (select site_no, regr_count(y, l) as n, regr_slope(y, l) as slope, regr_sxx(y, l) as sxx, regr_syy(y, l) as syy,
        regr_sxy(y, l) as sxy from s group by 1)
      select site_no, n::bigint as n, {r('slope')} as slope, {r('sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)')} as std_error,
        {r('slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)')} as t_stat from f""",
)
def dickey_fuller(t: Tables) -> DataFrame:
    return rounded(timeseries.dickey_fuller(spend(t), "x", ["site_no"], "date"))


_LAGS = """s as (select *, lag(x, 1) over w as l1, lag(x, 2) over w as l2, lag(x, 3) over w as l3 from spend
      window w as (partition by site_no order by date))"""


@query(
    "ar_forecast",
    f"""with recursive {SPEND_SPINE}, {_LAGS},
      n as (select site_no, {normal_sums('x', ['l1', 'l2', 'l3'])}, arg_max([x, l1, l2], date) as now from s where l3 is not null group by 1),
      {eliminate('n', ['site_no'], 4, kept=['now'])},
      f(site_no, b_0, b_1, b_2, b_3, step, x, y, z) as (
        select site_no, b_0, b_1, b_2, b_3, 0, now[1], now[2], now[3] from g
        union all select site_no, b_0, b_1, b_2, b_3, step + 1, b_0 + b_1 * x + b_2 * y + b_3 * z, x, y from f where step < 7)
      select site_no, {r('b_0')} as intercept, {r('b_1')} as lag1, {r('b_2')} as lag2, {r('b_3')} as lag3, step, {r('x')} as forecast from f where step > 0""",
)
def ar_forecast(t: Tables) -> DataFrame:
    told = timeseries.ar_forecast(spend(t), "x", ["site_no"], "date", lags=3, horizon=7)
    names = ("intercept", "lag1", "lag2", "lag3")
    return rounded(told.select("site_no", *(F.get("coef", F.lit(i)).alias(c) for i, c in enumerate(names)), "step", "forecast"))


@query(
    "dickey_fuller_lags",
    f"""with {SPEND_SPINE}, c as (select *, lag(x) over w as l, x - lag(x) over w as y from spend window w as (partition by site_no order by date)),
      s as (select *, lag(y, 1) over w as d1, lag(y, 2) over w as d2 from c window w as (partition by site_no order by date)),
      n as (select site_no, {normal_sums('y', ['l', 'd1', 'd2'])}, 0.0 as e_0, 1.0 as e_1, 0.0 as e_2, 0.0 as e_3, count(*) as n from s
        where d2 is not null group by 1),
      {eliminate('n', ['site_no'], 4, right=('b', 'e'), kept=['n'])},
      m as (select site_no, sum((y - b_0 - b_1 * l - b_2 * d1 - b_3 * d2) ** 2) as sse from s join g using (site_no) where d2 is not null group by 1)
      select site_no, n, {r('b_1')} as slope, {r('sqrt(sse / (n - 4) * e_1)')} as std_error, {r('b_1 / sqrt(sse / (n - 4) * e_1)')} as t_stat
      from g join m using (site_no)""",
)
def dickey_fuller_lags(t: Tables) -> DataFrame:
    return rounded(timeseries.dickey_fuller(spend(t), "x", ["site_no"], "date", lags=2))


@query(
    "ar1_fit",
    f"""with {SPEND_SPINE}, s as (select *, lag(x) over (partition by site_no order by date) as l from spend)
      select site_no, {r('regr_slope(x, l)')} as slope, {r('regr_intercept(x, l)')} as intercept,
        {r('regr_intercept(x, l) + regr_slope(x, l) * arg_max(x, date)')} as forecast from s group by 1""",
)
def ar1_fit(t: Tables) -> DataFrame:
    return rounded(timeseries.ar1_fit(spend(t), "x", ["site_no"], "date"))


@query(
    "lag_rolling_features",
    f"""with {SPEND_SPINE} select site_no, date, {r('x')} as x, {r('lag(x, 1) over w')} as x_lag1, {r('lag(x, 7) over w')} as x_lag7,
        {r('avg(x) over p')} as x_mean7, {r('min(x) over p')} as x_min7, {r('max(x) over p')} as x_max7 from spend
        window w as (partition by site_no order by date),
          p as (partition by site_no order by date rows between 7 preceding and 1 preceding)""",
)
def lag_rolling_features(t: Tables) -> DataFrame:
    return rounded(timeseries.lag_rolling_features(spend(t), "x", ["site_no"], "date"))


def _folds_sql(kind: str) -> str:
    train = "part < fold" if kind == "expanding" else "part = fold - 1"
    return f"""with e as (select min(ts) as lo, max(ts) as hi from events),
      p as (select event_id, ts, least(floor(date_diff('microsecond', lo, ts) * 5 / date_diff('microsecond', lo, hi))::int, 4) as part
        from events, e)
      select event_id, ts, fold::int as fold, case when part = fold then 'test' else 'train' end as role
      from p join (select unnest(range(1, 5)) as fold) f on part = fold or {train}"""


for _kind in ("expanding", "rolling"):
    query(f"temporal_folds_{_kind}", _folds_sql(_kind))(
        lambda t, kind=_kind: timeseries.temporal_folds(t.events.select("event_id", "ts"), "ts", 4, kind)
    )
