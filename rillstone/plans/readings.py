"""Payloads, inventories, alignment, daily features, gaps, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import day_of, rounded
from rillstone.functions.runtime import scratch_path
from rillstone.operators import features, filters, quality, shape
from rillstone.plans.registry import Tables, query, r
from rillstone.sources import files, inventory, payloads

BATCH = 64
CODES = {"click": "00060", "view": "00065", "error": "00010", "purchase": "00095", "signup": "00400"}
CODE_SQL = (
    "case event_type when 'click' then '00060' when 'view' then '00065' when 'error' then '00010' "
    "when 'purchase' then '00095' else '00400' end"
)


def readings(t: Tables) -> DataFrame:
    """Events as long readings: the user is the site, the event type the variable."""
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("event_type")]
    return t.events.select(
        F.col("user_id").cast("string").alias("site_no"),
        code.alias("code"),
        F.col("ts").alias("time"),
        "value",
        "event_id",
    )


def series(t: Tables) -> DataFrame:
    """Events as instantaneous readings of one variable, the event type being the site."""
    return t.events.select(
        F.col("event_type").alias("site_no"),
        F.col("ts").alias("time"),
        F.col("value").alias("discharge_cfs"),
    )


SERIES = "(select event_type as site_no, ts as time, value as discharge_cfs from events)"


def landed(t: Tables, daily: bool = False) -> DataFrame:
    """Events as payload text. A payload holds at most BATCH consecutive events of one site, so
    the list that is built is bounded. Values below 2 are written as empty text."""
    base = readings(t).withColumn("batch", F.floor(F.col("event_id") / BATCH))
    when = (
        F.date_format("time", "yyyy-MM-dd'T'00:00:00.000")
        if daily
        else F.concat(
            F.date_format(F.col("time") - F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.lit("-06:00"),
        )
    )
    text = F.when(F.col("value") < 2, "").otherwise(F.col("value").cast("string"))
    point = F.struct("code", when.alias("dateTime"), text.alias("value"))
    grouped = base.groupBy("site_no", "batch").agg(
        F.array_sort(F.collect_list(point)).alias("p")
    )

    def one(code: str):
        mine = F.transform(
            F.filter("p", lambda x: x["code"] == code), lambda x: F.struct(x["value"], x["dateTime"])
        )
        return F.struct(
            F.concat(F.lit("series:"), "site_no", F.lit(f":{code}")).alias("name"),
            F.struct(F.array(F.struct(F.lit(code).alias("value"))).alias("variableCode")).alias(
                "variable"
            ),
            F.array(F.struct(mine.alias("value"))).alias("values"),
        )

    body = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("q?sites="), "site_no").alias("queryURL")).alias("queryInfo"),
            F.array(*[one(c) for c in CODES.values()]).alias("timeSeries"),
        ).alias("value")
    )
    return grouped.select("site_no", "batch", F.to_json(body).alias("payload"))


@query(
    "iv_flatten",
    f"""select cast(user_id as varchar) as site_no, {CODE_SQL} as code, ts as time,
        case when value < 2 then null else value end as value from events""",
)
def iv_flatten(t: Tables) -> DataFrame:
    return payloads.instantaneous(payloads.parse_payloads(landed(t)))


@query(
    "dv_flatten",
    f"""select cast(user_id as varchar) as site_no, '00003' as stat_cd, {CODE_SQL} as code,
        cast(ts as date) as date, case when value < 2 then null else value end as value from events""",
)
def dv_flatten(t: Tables) -> DataFrame:
    parsed = payloads.parse_payloads(landed(t, daily=True))
    return payloads.daily(parsed.withColumn("stat_cd", F.lit(payloads.STATISTICS["mean"])))


@query(
    "value_decode",
    """select event_id, case when value < 2 then null when value > 90 then null else value end as strict_value,
        case when value < 2 then null when value > 90 then -999999.0 else value end as sentinel_kept,
        case when value < 2 or value between 3 and 4 then null else value end as lenient_value from events""",
)
def value_decode(t: Tables) -> DataFrame:
    from rillstone.functions.columns import decode_reading

    text = F.col("value").cast("string")
    blank = F.when(F.col("value") < 2, "")
    sentinel = blank.when(F.col("value") > 90, "-999999").otherwise(text)
    bad = blank.when(F.col("value").between(3, 4), "Ice").otherwise(text)
    return t.events.select(
        "event_id",
        decode_reading(sentinel, no_data=[-999999.0]).alias("strict_value"),
        decode_reading(sentinel).alias("sentinel_kept"),
        decode_reading(bad, on_bad="null").alias("lenient_value"),
    )


@query("ts_normalize", "select event_id, ts as time, ts as time_z, cast(ts as date) as date from events")
def ts_normalize(t: Tables) -> DataFrame:
    from rillstone.functions.columns import utc_instant

    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    east = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 330 MINUTES"), pattern), F.lit("+05:30"))
    zulu = F.concat(F.date_format("ts", pattern), F.lit("Z"))
    return t.events.select(
        "event_id",
        utc_instant(east).alias("time"),
        utc_instant(zulu).alias("time_z"),
        F.to_date(F.substring(zulu, 1, 10)).alias("date"),
    )


@query(
    "payload_probe",
    f"""with e as (select *, {CODE_SQL} as code, event_id // {BATCH} as batch from events)
        select cast(user_id as varchar) as site_no, batch::bigint as batch,
          'q?sites=' || user_id as query_url, 'series:' || user_id || ':00060' as first_name,
          min(case when code = '00060' then strftime(ts - interval 6 hour, '%Y-%m-%dT%H:%M:%S.%f') || '-06:00' end)
            as first_time,
          arg_min(case when value < 2 then '' else value::varchar end, ts) filter (where code = '00060')
            as first_value
        from e group by user_id, batch""",
)
def payload_probe(t: Tables) -> DataFrame:
    return payloads.probe(payloads.parse_payloads(landed(t)), ["site_no", "batch"])


def _wide(names: bool) -> str:
    known = {"00060": "discharge_cfs", "00065": "stage_ft"} if names else {}
    return ", ".join(
        f"""max(case when event_type = '{e}' then value end) as "{known.get(c, c)}\"""" for e, c in CODES.items()
    )


@query(
    "align_variables",
    f"select cast(user_id as varchar) as site_no, cast(ts as date)::timestamp as time, {_wide(False)} from events group by 1, 2",
)
def align_variables(t: Tables) -> DataFrame:
    base = readings(t).withColumn("time", day_of("time"))
    return shape.align_variables(base, duplicates="max")


@query("rename_codes", f"select cast(user_id as varchar) as site_no, ts as time, {_wide(True)} from events group by 1, 2")
def rename_codes(t: Tables) -> DataFrame:
    """Every reading has its own time here, so the strict policy on repeats holds. Codes without a name stay."""
    return shape.rename_codes(shape.align_variables(readings(t)))


@query(
    "to_local",
    """select event_id, ts as time, timezone('America/Denver', timezone('UTC', ts)) as local_time from events""",
)
def to_local(t: Tables) -> DataFrame:
    df = t.events.select("event_id", F.col("ts").alias("time"))
    return shape.to_local(df, into="local_time")


@query(
    "coerce_datetimes",
    """select o_orderkey, o_orderdate as mostly_dates,
         case when o_totalprice > 250000 then null else strftime(o_orderdate, '%Y-%m-%d') end as half_dates,
         o_orderstatus as status from orders""",
)
def coerce_datetimes(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = t.orders.select(
        "o_orderkey",
        day.alias("mostly_dates"),
        F.when(F.col("o_totalprice") <= 250000, day).alias("half_dates"),
        F.col("o_orderstatus").alias("status"),
    )
    return shape.coerce_datetimes(df)


@query(
    "coerce_time_column",
    """select o_orderkey, case when o_orderstatus = 'F' then null else o_orderdate end as time from orders""",
)
def coerce_time_column(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy")
    )
    return shape.coerce_time_column(t.orders.select("o_orderkey", text.alias("time")), "time")


@query(
    "chart_frame",
    f"""with w as (select cast(user_id as varchar) as site_no, ts as time, {_wide(True)} from events group by 1, 2)
       select site_no, cast(time as date)::timestamp as t, field, min(v) as low, max(v) as high, {r('avg(v)', 6)} as mean, count(v) as n
       from w unpivot include nulls (v for field in (discharge_cfs, stage_ft, "00010", "00095", "00400")) group by 1, 2, 3""",
)
def chart_frame(t: Tables) -> DataFrame:
    wide = shape.rename_codes(shape.align_variables(readings(t)))
    return rounded(shape.chart_frame(wide, [c for c in wide.columns if c not in ("site_no", "time")]), 6)


# --- inventory -------------------------------------------------------------------------------

INVENTORY_COLUMNS = ["site_no", "station_nm", "state_cd", "site_type", "status"]


def inventory_lines(t: Tables) -> DataFrame:
    """Supplier rows as inventory text, one file per nation: comments, blank line, header with a
    trailing space, type line, then rows of which some are short, long or incomplete."""
    nation = t.nation.select("n_nationkey", F.col("n_name").alias("file"))
    head = nation.select(
        "file",
        F.posexplode(
            F.array(
                F.lit("# inventory"),
                F.lit(""),
                F.lit("site_no\tstation_nm \tstate_cd\tsite_type\tstatus"),
                F.lit("15s\t50s\t2s\t7s\t8s"),
            )
        ).alias("line_no", "line"),
    )
    bal = F.col("s_acctbal")
    state = F.when(bal.between(0, 500), "").otherwise(F.substring("file", 1, 2))
    name = F.when(bal.between(500, 1000), "").otherwise(F.col("s_name"))
    fields = [
        F.col("s_suppkey").cast("string"),
        name,
        state,
        F.when(bal > 5000, "ST").otherwise("GW"),
        F.when(bal > 7000, "active").otherwise("inactive"),
    ]
    good = F.concat_ws("\t", *fields)
    line = (
        F.when(bal < 0, F.concat_ws("\t", *fields[:3]))
        .when(bal > 9500, F.concat(good, F.lit("\textra")))
        .otherwise(good)
    )
    body = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "file", (F.col("s_suppkey").cast("int") + 10).alias("line_no"), line.alias("line")
    )
    return head.unionByName(body)


SITES_SQL = """(select n_name as file, s_suppkey + 10 as line_no, cast(s_suppkey as varchar) as site_no,
    case when s_acctbal between 500 and 1000 then '' else s_name end as station_nm,
    case when s_acctbal between 0 and 500 then '' else substr(n_name, 1, 2) end as state_cd,
    case when s_acctbal > 5000 then 'ST' else 'GW' end as site_type,
    case when s_acctbal > 7000 then 'active' else 'inactive' end as status, s_acctbal
    from supplier join nation on s_nationkey = n_nationkey)"""


@query(
    "rdb_parse",
    f"""select file, cast(line_no as int) as line_no, site_no, station_nm, state_cd, site_type, status
        from {SITES_SQL} where s_acctbal between 0 and 9500""",
)
def rdb_parse(t: Tables) -> DataFrame:
    return inventory.parse_inventory(inventory_lines(t), INVENTORY_COLUMNS)


@query(
    "malformed_row_filter",
    f"""select file, count(*) as n_lines, count(*) filter (where s_acctbal < 0 or s_acctbal > 9500) as n_rejected
        from {SITES_SQL} group by file""",
)
def malformed_row_filter(t: Tables) -> DataFrame:
    return inventory.inventory_rejects(inventory_lines(t))


LABEL_SQL = """case when state_cd <> '' then station_nm || ', ' || state_cd || ' (' || site_no || ')'
    else station_nm || ' (' || site_no || ')' end"""


@query(
    "site_labels",
    f"""select {LABEL_SQL} as label, max(site_no) as site_no from {SITES_SQL}
        where s_acctbal between 0 and 9500 and station_nm <> '' group by 1""",
)
def site_labels(t: Tables) -> DataFrame:
    return inventory.site_labels(inventory.parse_inventory(inventory_lines(t), INVENTORY_COLUMNS))


@query(
    "site_discovery",
    f"""select file, site_no, station_nm, state_cd, status from {SITES_SQL}
        where s_acctbal between 0 and 9500 and site_type = 'ST' and status = 'active'
          and state_cd in ('NA', 'UN', 'IN')""",
)
def site_discovery(t: Tables) -> DataFrame:
    """Nation names start with NA in the tables; the state list is deliberately untidy."""
    sites = inventory.parse_inventory(inventory_lines(t), INVENTORY_COLUMNS)
    found = inventory.discover_sites(sites, [" na", "UN ", "in", "", "NA"], status="active")
    return found.select("file", "site_no", "station_nm", "state_cd", "status")


@query(
    "site_discovery_default",
    f"""select file, site_no, station_nm, 'CO' as state_cd, status, ['00060', '00065', '00010'][site_no::bigint % 3 + 1] as parm_cd from {SITES_SQL}
        where s_acctbal between 0 and 9500 and site_type = 'ST' and status = 'active' and state_cd = 'NA' and site_no::bigint % 3 < 2""",
)
def site_discovery_default(t: Tables) -> DataFrame:
    """The usual wishes over an inventory with a variable for each site; one state stands for the usual one."""
    sites = inventory.parse_inventory(inventory_lines(t), INVENTORY_COLUMNS)
    variable = F.get(F.array(*map(F.lit, ("00060", "00065", "00010"))), (F.col("site_no").cast("bigint") % 3).cast("int"))
    sites = sites.withColumn("parm_cd", variable).replace("NA", "CO", "state_cd")
    return inventory.discover_default_sites(sites).select("file", "site_no", "station_nm", "state_cd", "status", "parm_cd")


@query(
    "label_by_catalog",
    """select label, cast(user_id as varchar) as site_no, count(*) as n, min(ts) as first_time from events
       join (select case when c_acctbal < 0 then '  ' else c_name end as label, c_custkey from customer) c
         on c_custkey = user_id where trim(label) <> '' group by all""",
)
def label_by_catalog(t: Tables) -> DataFrame:
    catalog = t.customer.select(
        F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_name")).alias("label"),
        F.col("c_custkey").cast("string").alias("site_no"),
    )
    labelled = inventory.label_readings(readings(t), catalog)
    return labelled.groupBy("label", "site_no").agg(
        F.count("*").alias("n"), F.min("time").alias("first_time")
    )


# --- files -----------------------------------------------------------------------------------


@query("parquet_pruned", "select event_id, value from events")
def parquet_pruned(t: Tables) -> DataFrame:
    return files.read_parquet(t.spark, [t.path("events")], ["event_id", "value"])


@query(
    "per_file_scan",
    """select 'orders' as name, count(*) as n_rows, min(o_orderdate) as first_time, max(o_orderdate) as last_time
       from orders""",
)
def per_file_scan(t: Tables) -> DataFrame:
    """A path, the same by a glob, and one that is not there."""
    found, missing = files.resolve_paths(
        t.spark, [t.path("orders"), f"{t.folder}/order*.parquet", f"{t.folder}/absent-*.parquet"]
    )
    if not missing:
        raise ValueError("the absent path was not reported")
    df = files.read_parquet(t.spark, found, ["o_orderdate"], with_file=True)
    report = files.per_file(
        df,
        F.count("*").alias("n_rows"),
        F.min("o_orderdate").alias("first_time"),
        F.max("o_orderdate").alias("last_time"),
    )
    # A table may be one file or a folder of files.
    name = F.regexp_extract("file", r"/([^/]+)\.parquet(?:/[^/]+)?$", 1)
    return report.groupBy(name.alias("name")).agg(
        F.sum("n_rows").alias("n_rows"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


@query(
    "csv_scan",
    """select p_partkey, p_name, case when p_brand = 'Brand#7' then null else p_brand end as p_brand,
         p_retailprice from part""",
)
def csv_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv_scan")
    brand = F.when(F.col("p_brand") == "Brand#7", "NA").otherwise(F.col("p_brand"))
    t.part.withColumn("p_brand", brand).write.csv(path, header=True)
    return files.read_csv(
        t.spark, path, t.part.schema, ["p_partkey", "p_name", "p_brand", "p_retailprice"]
    )


@query(
    "dataset_info",
    """select 'lineitem' as name, count(*) as n_rows, 3::bigint as n_columns, true as has_bytes from lineitem""",
)
def dataset_info(t: Tables) -> DataFrame:
    df = files.read_parquet(
        t.spark, [t.path("lineitem")], ["l_orderkey", "l_quantity", "l_shipdate"], with_file=True
    )
    info = files.dataset_info(df)
    name = F.regexp_extract("file", r"/([^/]+)\.parquet(?:/[^/]+)?$", 1)
    return info.groupBy(name.alias("name")).agg(
        F.sum("n_rows").alias("n_rows"),
        F.max("n_columns").alias("n_columns"),
        (F.sum("n_bytes") > 0).alias("has_bytes"),
    )


@query(
    "materialize_if_absent",
    "select ts as time, value as discharge_cfs, event_type as site_no from events",
)
def materialize_if_absent(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "cache")
    tag = files.window_tag("iv", 30)
    files.materialize_if_absent(t.spark, root, tag, lambda: series(t))

    def never() -> DataFrame:
        raise RuntimeError("a finished table must be read back")

    back = files.materialize_if_absent(t.spark, root, tag, never)
    return back.select("time", "discharge_cfs", "site_no")


# --- filters ---------------------------------------------------------------------------------


@query(
    "trailing_window",
    """select event_id, ts as time, value from events
       where ts >= (select max(ts) from events) - interval 7 day""",
)
def trailing_window(t: Tables) -> DataFrame:
    return filters.trailing_window(t.events.select("event_id", F.col("ts").alias("time"), "value"))


@query(
    "trailing_window_years",
    """select o_orderkey, o_orderdate from orders
       where o_orderdate >= (select max(o_orderdate) from orders) - interval 730 day""",
)
def trailing_window_years(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderdate")
    return filters.trailing_window(df, years=2, time_col="o_orderdate")


@query(
    "time_range",
    """select event_id, ts as time, value from events
       where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 12:00:00'""",
)
def time_range(t: Tables) -> DataFrame:
    df = t.events.select("event_id", F.col("ts").alias("time"), "value")
    return filters.time_range(df, start="2024-01-05", end="2024-01-12T14:00:00+02:00")


@query(
    "where_expr",
    """select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem
       where l_quantity > 30 and (l_discount >= 0.05 or l_returnflag = 'R')""",
)
def where_expr(t: Tables) -> DataFrame:
    kept = filters.where_expr(
        t.lineitem, "l_quantity > 30 AND (l_discount >= 0.05 OR l_returnflag = 'R')"
    )
    return shape.select_columns(kept, "l_orderkey, l_linenumber,, l_quantity , l_discount")


@query("select_columns", "select l_orderkey, l_tax, l_shipdate from lineitem")
def select_columns(t: Tables) -> DataFrame:
    return shape.select_columns(t.lineitem, " l_orderkey, l_tax ,,l_shipdate")


@query(
    "non_null_only",
    """select p_partkey, nullif(p_type, 'PROMO') as dep_type from part where p_type <> 'PROMO'""",
)
def non_null_only(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("dep_type"))
    return filters.non_null_only(df, "dep_type")


# --- features and quality --------------------------------------------------------------------

DAILY_SQL = f"""days as (
    select site_no, cast(time as date)::timestamp as date, avg(discharge_cfs) as discharge_cfs_mean,
      max(discharge_cfs) as discharge_cfs_max, min(discharge_cfs) as discharge_cfs_min
    from (select site_no, time, discharge_cfs from {SERIES} where discharge_cfs > {{low}}) group by 1, 2),
  spine as (select site_no, unnest(generate_series(min(date), max(date), interval 1 day)) as date
    from days group by site_no),
  daily as (select s.site_no, s.date, d.discharge_cfs_mean, d.discharge_cfs_max, d.discharge_cfs_min
    from spine s left join days d on d.site_no = s.site_no and d.date = s.date)"""


def daily(t: Tables, low: float = -1e18) -> DataFrame:
    return features.daily_features(series(t).filter(F.col("discharge_cfs") > low))


@query(
    "daily_features",
    f"""with {DAILY_SQL.format(low='-1e18')}
      select site_no, date, {r('discharge_cfs_mean', 6)} as discharge_cfs_mean, {r('discharge_cfs_max', 6)} as discharge_cfs_max,
        {r('discharge_cfs_min', 6)} as discharge_cfs_min from daily""",
)
def daily_features(t: Tables) -> DataFrame:
    return rounded(daily(t), 6)


@query(
    "daily_features_holes",
    f"""with days as (select user_id, cast(ts as date)::timestamp as date, avg(value) as m, max(value) as h, min(value) as l
        from events group by 1, 2),
      spine as (select user_id, unnest(generate_series(min(date), max(date), interval 1 day)) as date from days group by 1)
      select cast(s.user_id as varchar) as site_no, s.date, {r('m', 6)} as stage_ft_mean, {r('h', 6)} as stage_ft_max,
        {r('l', 6)} as stage_ft_min from spine s left join days d on d.user_id = s.user_id and d.date = s.date""",
)
def daily_features_holes(t: Tables) -> DataFrame:
    """Sites with few readings, so some days are empty."""
    df = readings(t).select("site_no", "time", F.col("value").alias("stage_ft"))
    return rounded(features.daily_features(df), 6)


@query(
    "gap_summary",
    f"""with s as (select site_no, time, date_diff('microsecond', lag(time) over (partition by site_no order by time), time) as d
        from {SERIES})
      select site_no, count(*)::double as count, min(time) as start, max(time) as "end",
        {r('median(d) / 1e6', 7)} as median_step_sec, {r('max(d) / 1e6', 7)} as max_gap_sec,
        {r("1 - count(*) / nullif(date_diff('microsecond', min(time), max(time)) / 1e6 / 900, 0)", 6)} as pct_missing_vs_15min
      from s group by site_no""",
)
def gap_summary(t: Tables) -> DataFrame:
    return _gaps(quality.gap_summary(series(t)))


def _gaps(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "median_step_sec": F.round("median_step_sec", 7) + F.lit(0.0),
            "max_gap_sec": F.round("max_gap_sec", 7) + F.lit(0.0),
            "pct_missing_vs_15min": F.round("pct_missing_vs_15min", 6) + F.lit(0.0),
        }
    )


@query(
    "gap_summary_local",
    f"""with l as (select cast(user_id as varchar) as site_no, ts as time, timezone('America/Denver', timezone('UTC', ts + interval 60 day)) as w from events),
      s as (select site_no, w, date_diff('microsecond', lag(w) over (partition by site_no order by time), w) as d from l)
      select site_no, count(*)::double as count, min(w) as start, max(w) as "end",
        {r('median(d) / 1e6', 7)} as median_step_sec, {r('max(d) / 1e6', 7)} as max_gap_sec,
        {r("1 - count(*) / nullif(date_diff('microsecond', min(w), max(w)) / 1e6 / 900, 0)", 6)} as pct_missing_vs_15min
      from s group by site_no""",
)
def gap_summary_local(t: Tables) -> DataFrame:
    """Moved by 60 days so that the spring clock change lies inside the readings."""
    df = readings(t).select("site_no", (F.col("time") + F.expr("INTERVAL 60 DAYS")).alias("time"))
    return _gaps(quality.gap_summary_local(df))


@query(
    "step_delta",
    f"""select site_no, time, d as step_us, {r('d / 1e6', 6)} as step_sec from (
        select site_no, time, date_diff('microsecond', lag(time) over (partition by site_no order by time), time) as d
        from {SERIES}) where d is not null""",
)
def step_delta(t: Tables) -> DataFrame:
    return rounded(quality.step_delta(series(t)), 6)


ORDER_DAYS = """(select o_orderstatus as site_no, o_orderdate as date, ln(sum(o_totalprice)) as total, count(*) as n
    from orders group by 1, 2)"""


def order_days(t: Tables) -> DataFrame:
    """Log of the daily totals, with an integer column that gets no statistics."""
    return t.orders.groupBy(
        F.col("o_orderstatus").alias("site_no"), F.col("o_orderdate").alias("date")
    ).agg(F.log(F.sum("o_totalprice")).alias("total"), F.count("*").alias("n"))


def _roll(c: str, fn: str, n: int) -> str:
    return f"case when count({c}) over w >= 7 then {fn}({c}) over w end"


@query(
    "rolling_mean_std",
    f"""select site_no, date, {r('total')} as total, n, {r(_roll('total', 'avg', 30))} as total_roll_mean,
        {r(_roll('total', 'stddev_samp', 30))} as total_roll_std from {ORDER_DAYS}
        window w as (partition by site_no order by date rows between 29 preceding and current row)""",
)
def rolling_mean_std(t: Tables) -> DataFrame:
    return rounded(features.rolling_mean_std(order_days(t)))


def _scores(df: DataFrame) -> DataFrame:
    """Scores at four digits, daily values at six."""
    digits = {c: 4 if c.endswith("_z") else 6 for c in features.float_columns(df)}
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})


def _z(c: str) -> str:
    return f"({c} - {_roll(c, 'avg', 30)}) / nullif({_roll(c, 'stddev_samp', 30)}, 0)"


@query(
    "rolling_anomaly_z",
    f"""with {DAILY_SQL.format(low='-1e18')}
      select site_no, date, {r('discharge_cfs_mean', 6)} as discharge_cfs_mean, {r('discharge_cfs_max', 6)} as discharge_cfs_max,
        {r('discharge_cfs_min', 6)} as discharge_cfs_min, {r(_z('discharge_cfs_mean'))} as discharge_cfs_mean_z,
        {r(_z('discharge_cfs_max'))} as discharge_cfs_max_z, {r(_z('discharge_cfs_min'))} as discharge_cfs_min_z
      from daily window w as (partition by site_no order by date rows between 29 preceding and current row)""",
)
def rolling_anomaly_z(t: Tables) -> DataFrame:
    return _scores(features.rolling_anomaly_z(daily(t)))


@query(
    "rolling_anomaly_z_holes",
    f"""with {DAILY_SQL.format(low='150')}
      select site_no, date, {r('discharge_cfs_mean', 6)} as discharge_cfs_mean, {r('discharge_cfs_max', 6)} as discharge_cfs_max,
        {r('discharge_cfs_min', 6)} as discharge_cfs_min, {r(_z('discharge_cfs_mean'))} as discharge_cfs_mean_z,
        {r(_z('discharge_cfs_max'))} as discharge_cfs_max_z, {r(_z('discharge_cfs_min'))} as discharge_cfs_min_z
      from daily window w as (partition by site_no order by date rows between 29 preceding and current row)""",
)
def rolling_anomaly_z_holes(t: Tables) -> DataFrame:
    """Only high readings, so empty days take a place in the rolling window."""
    return _scores(features.rolling_anomaly_z(daily(t, 150.0)))


@query(
    "rolling_anomaly_z_empty_days",
    f"""with days as (select user_id, cast(ts as date)::timestamp as date, avg(value) as m, max(value) as h, min(value) as l
        from events group by 1, 2),
      spine as (select user_id, unnest(generate_series(min(date), max(date), interval 1 day)) as date from days group by 1),
      daily as (select cast(s.user_id as varchar) as site_no, s.date, m, h, l
        from spine s left join days d on d.user_id = s.user_id and d.date = s.date)
      select site_no, date, {r('m', 6)} as stage_ft_mean, {r('h', 6)} as stage_ft_max, {r('l', 6)} as stage_ft_min,
        {r(_z('m'))} as stage_ft_mean_z, {r(_z('h'))} as stage_ft_max_z, {r(_z('l'))} as stage_ft_min_z
      from daily window w as (partition by site_no order by date rows between 29 preceding and current row)""",
)
def rolling_anomaly_z_empty_days(t: Tables) -> DataFrame:
    """All readings, of sites with empty days."""
    df = readings(t).select("site_no", "time", F.col("value").alias("stage_ft"))
    return _scores(features.rolling_anomaly_z(features.daily_features(df)))
