"""Profiles of record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import rounded
from rillstone.operators import profile, shape
from rillstone.plans.registry import Tables, query, r

# Parts as mineral records: brand as state, type as deposit type; one value of each is made null
# and one blank, because the tables have no nulls.
RECORDS = """(select p_partkey, nullif(p_brand, 'Brand#3') as state,
    case p_type when 'PROMO' then null when 'SMALL' then '' else p_type end as dep_type,
    p_retailprice, p_size from part)"""


def records(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#3")).alias("state"),
        F.when(F.col("p_type") == "SMALL", "")
        .otherwise(F.nullif("p_type", F.lit("PROMO")))
        .alias("dep_type"),
        "p_retailprice",
        "p_size",
    )


@query("missing_label", f"""select p_partkey, coalesce(dep_type, '<missing>') as dep_type,
    coalesce(nullif(dep_type, ''), '<missing>') as dep_type_blank from {RECORDS}""")
def missing_label(t: Tables) -> DataFrame:
    df = records(t).select("p_partkey", "dep_type", F.col("dep_type").alias("dep_type_blank"))
    return shape.label_missing(shape.label_missing(df, "dep_type"), "dep_type_blank", True)


@query("count_by_state", f"select state, count(*) as count from {RECORDS} group by state")
def count_by_state(t: Tables) -> DataFrame:
    return profile.count_by(records(t), "state")


@query(
    "count_by_dep_type",
    f"select coalesce(dep_type, '<missing>') as dep_type, count(*) as count from {RECORDS} group by 1",
)
def count_by_dep_type(t: Tables) -> DataFrame:
    return profile.count_by(records(t), "dep_type", label_missing=True)


@query(
    "count_by_dep_type_blank",
    f"select coalesce(nullif(dep_type, ''), '<missing>') as dep_type, count(*) as count from {RECORDS} group by 1",
)
def count_by_dep_type_blank(t: Tables) -> DataFrame:
    return profile.count_by(records(t), "dep_type", label_missing=True, blank_is_missing=True)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _summary_sql(table: str, column: str) -> str:
    stats = {
        "count": f"count({column})",
        "mean": f"avg({column})",
        "std": f"stddev_samp({column})",
        "min": f"min({column})",
        "25%": f"quantile_cont({column}::double, 0.25)",
        "50%": f"quantile_cont({column}::double, 0.5)",
        "75%": f"quantile_cont({column}::double, 0.75)",
        "max": f"max({column})",
    }
    return " union all ".join(
        f"select '{column}' as \"column\", '{s}' as stat, {r(e, 3)} as value from {table}"
        for s, e in stats.items()
    )


@query("numeric_summary", " union all ".join(_summary_sql("lineitem", c) for c in NUMBERS))
def numeric_summary(t: Tables) -> DataFrame:
    return rounded(profile.numeric_summary(t.lineitem, NUMBERS), 3)


@query(
    "r_summary",
    " union all ".join(
        f"""select '{c}' as "column", {r(f'min({c})')} as min, {r(f'quantile_cont({c}::double, 0.25)')} as first_quartile,
        {r(f'median({c}::double)')} as median, {r(f'avg({c})')} as mean, {r(f'quantile_cont({c}::double, 0.75)')} as third_quartile,
        {r(f'max({c})')} as max, count(*) filter (where {c} is null) as n_null
        from (select c_nationkey, nullif(c_acctbal, 0) as c_acctbal from customer)"""
        for c in ["c_acctbal", "c_nationkey"]
    ),
)
def r_summary(t: Tables) -> DataFrame:
    df = t.customer.select("c_nationkey", F.nullif("c_acctbal", F.lit(0.0)).alias("c_acctbal"))
    return rounded(profile.six_number_summary(df, ["c_acctbal", "c_nationkey"]))


def _describe_sql() -> str:
    none = "null::bigint as \"unique\", null::varchar as top, null::bigint as freq"
    no_num = ", ".join(f"null::double as {c}" for c in ["mean", "std", "min", "q25", "q50", "q75", "max"])
    no_time = ", ".join(
        f"null::timestamp as {c}_time" for c in ["mean", "min", "q25", "q50", "q75", "max"]
    )
    parts = []
    for c in ["o_orderkey", "o_custkey", "o_totalprice"]:
        parts.append(
            f"""select '{c}' as "column", 'number' as kind, count({c}) as count, {none}, {r(f'avg({c})', 3)} as mean,
            {r(f'stddev_samp({c})', 3)} as std, {r(f'min({c})', 3)} as min, {r(f'quantile_cont({c}::double, 0.25)', 3)} as q25,
            {r(f'median({c}::double)', 3)} as q50, {r(f'quantile_cont({c}::double, 0.75)', 3)} as q75, {r(f'max({c})', 3)} as max,
            {no_time} from orders"""
        )
    us = "epoch_us(o_orderdate)"

    def ts(e: str) -> str:
        return f"make_timestamp(cast(round({e}) as bigint))"

    parts.append(
        f"""select 'o_orderdate', 'time', count(o_orderdate), {none}, {no_num}, date_trunc('second', {ts(f'avg({us})')}), min(o_orderdate),
        {ts(f'quantile_cont({us}::double, 0.25)')}, {ts(f'median({us}::double)')}, {ts(f'quantile_cont({us}::double, 0.75)')},
        max(o_orderdate) from orders"""
    )
    for c in ["o_orderstatus", "o_orderpriority"]:
        parts.append(
            f"""select '{c}', 'text', sum(n)::bigint, count(*), first(v order by n desc, v), max(n), {no_num}, {no_time}
            from (select {c} as v, count(*) as n from orders group by 1)"""
        )
    return " union all ".join(parts)


@query("describe_all", _describe_sql())
def describe_all(t: Tables) -> DataFrame:
    out = rounded(profile.describe_all(t.orders), 3)
    # The mean of times is a quotient; whole seconds are compared.
    return out.withColumn("mean_time", F.date_trunc("second", "mean_time").cast("timestamp_ntz"))


@query("time_extent", "select min(ts) as first_time, max(ts) as last_time from events")
def time_extent(t: Tables) -> DataFrame:
    return profile.time_extent(t.events, "ts")


@query(
    "time_extent_by_series",
    "select event_type, min(ts) as first_time, max(ts) as last_time from events group by 1",
)
def time_extent_by_series(t: Tables) -> DataFrame:
    return profile.time_extent(t.events, "ts", ["event_type"])


@query(
    "distinct_sorted",
    f"""select state, (select count(distinct state) from {RECORDS}) as n_distinct
        from (select distinct state from {RECORDS} where state is not null) order by state limit 10""",
)
def distinct_sorted(t: Tables) -> DataFrame:
    return profile.distinct_sorted(records(t), "state")


@query(
    "dataset_overview",
    f"""select 'rows' as item, count(*)::varchar as value from {RECORDS}
      union all select 'columns', '5'
      union all select 'states', count(distinct state)::varchar from {RECORDS}
      union all select 'dep_types', count(distinct dep_type)::varchar from {RECORDS}
      union all select distinct 'state', state from {RECORDS} where state is not null
      union all (select distinct 'dep_type', dep_type from {RECORDS} where dep_type is not null order by dep_type limit 10)""",
)
def dataset_overview(t: Tables) -> DataFrame:
    return profile.dataset_overview(records(t))


@query(
    "sort_desc",
    "select l_suppkey, count(*) as count from lineitem group by 1",
)
def sort_desc(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("count"))
    return profile.sort_desc(counts, "count", "l_suppkey")


@query(
    "top_n",
    "select l_suppkey, count(*) as count from lineitem group by 1 order by count desc, l_suppkey limit 10",
)
def top_n(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("count"))
    return profile.top_n(counts, "count", 10, "l_suppkey")


@query("head_n", "select event_id, ts, value from events order by ts, event_id limit 20")
def head_n(t: Tables) -> DataFrame:
    return profile.head_n(t.events.select("event_id", "ts", "value"), 20, "ts", "event_id")


@query("tail_n", "select event_id, ts, value from events order by ts desc, event_id desc limit 20")
def tail_n(t: Tables) -> DataFrame:
    return profile.tail_n(t.events.select("event_id", "ts", "value"), 20, "ts", "event_id")


@query(
    "tail_n_per_series",
    """select event_type, event_id, ts, value from events
       qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 10""",
)
def tail_n_per_series(t: Tables) -> DataFrame:
    df = t.events.select("event_type", "event_id", "ts", "value")
    return profile.tail_n_per_series(df, 10, ["event_type"], "ts", "event_id")


@query("sample_n", "select event_id, ts, value from events order by md5(event_id || ':0'), event_id limit 50")
def sample_n(t: Tables) -> DataFrame:
    return profile.sample_n(t.events.select("event_id", "ts", "value"), 50, "event_id")
