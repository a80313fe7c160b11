"""Tab-separated site inventories and the label catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillstone.functions.columns import join_null_safe


def read_inventory_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with their file and their order in it. Spark may split a file, so the order is the
    line's place among its bytes: each file is read whole, which suits files of inventory size."""
    whole = spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    # A trailing carriage return belongs to the line break.
    return whole.select(
        "file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line")
    )


def _content(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _with_header(lines: DataFrame) -> DataFrame:
    """Data lines joined to the header of their file. Header and type line are the two smallest
    line numbers, found by an aggregate, not by sorting the file."""
    content = _content(lines).withColumn("_fields", F.split("line", "\t"))
    first = content.groupBy("file").agg(
        F.min_by("_fields", "line_no").alias("_header"), F.min("line_no").alias("_first")
    )
    rest = join_null_safe(content, first, ["file"]).filter(F.col("line_no") > F.col("_first"))
    second = rest.groupBy("file").agg(F.min("line_no").alias("_second"))
    return join_null_safe(rest, second, ["file"]).filter(F.col("line_no") > F.col("_second"))


def parse_inventory(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of well-formed lines, every value text. A header name may carry one trailing space.
    A column that a file lacks is null there."""
    rows = _with_header(lines).filter(F.size("_fields") == F.size("_header"))
    names = F.transform("_header", lambda h: F.regexp_replace(h, " $", ""))

    def field(name: str) -> Column:
        return F.get("_fields", (F.array_position("_names", name) - 1).cast("int"))

    return rows.withColumn("_names", names).select(
        "file", "line_no", *[field(c).alias(c) for c in columns]
    )


def inventory_rejects(lines: DataFrame) -> DataFrame:
    """Lines per file whose field count differs from the header's."""
    bad = F.size("_fields") != F.size("_header")
    return (
        _with_header(lines)
        .groupBy("file")
        .agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_rejected"))
    )


def drop_incomplete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows in which every required text is present and not empty."""
    for c in required:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return df


def site_labels(
    sites: DataFrame,
    number: str = "site_no",
    name: str = "station_nm",
    state: str | None = "state_cd",
) -> DataFrame:
    """``(label, site_no)``, one row per label."""
    kept = drop_incomplete(sites, [number, name])
    plain = F.format_string("%s (%s)", F.col(name), F.col(number))
    label = plain
    if state is not None:
        full = F.format_string("%s, %s (%s)", F.col(name), F.col(state), F.col(number))
        label = F.when(F.col(state).isNotNull() & (F.col(state) != ""), full).otherwise(plain)
    return (
        kept.select(label.alias("label"), F.col(number).alias("site_no"))
        .groupBy("label")
        .agg(F.max("site_no").alias("site_no"))
    )


BLANKS = " \t\r\n"


def discover_sites(
    sites: DataFrame,
    states: Sequence[str],
    status: str = "all",
    site_type: str = "ST",
    variables: Sequence[str] = (),
    state_col: str = "state_cd",
    status_col: str = "status",
    type_col: str = "site_type",
    variable_col: str = "parm_cd",
) -> DataFrame:
    """Inventory rows of the wanted kind. States may have blanks around them and any case, blank ones count for
    nothing; they are constants, so the scan gets the list."""
    wanted = [F.upper(F.btrim(F.lit(s), F.lit(BLANKS))) for s in states]
    out = sites.filter(F.col(type_col) == site_type).filter((F.col(state_col) != "") & F.col(state_col).isin(wanted))
    if status != "all":
        out = out.filter(F.col(status_col) == status)
    if variables:
        out = out.filter(F.col(variable_col).isin(list(variables)))
    return out


# What is looked for when nothing is said: streams of one state, discharge and stage, sites in use.
DISCOVERY = {"states": ("CO",), "variables": ("00060", "00065"), "status": "active", "site_type": "ST"}


def discover_default_sites(sites: DataFrame, **changes) -> DataFrame:
    """``discover_sites`` with the usual wishes, but for those given."""
    return discover_sites(sites, **{**DISCOVERY, **changes})


def valid_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.filter((F.btrim("label", F.lit(BLANKS)) != "") & (F.btrim("site_no", F.lit(BLANKS)) != ""))


def label_readings(readings: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Readings of all sites with their labels. Spark broadcasts the catalogue when its measured
    size is below the session threshold and shuffles otherwise."""
    return readings.join(valid_catalog(catalog), "site_no", how)


# The catalogue used when none is configured.
DEFAULT_SITES = {
    "Colorado River near Cameo (09095500)": "09095500",
    "Gunnison River near Grand Junction (09152500)": "09152500",
    "Colorado River at CO–UT State Line (09163500)": "09163500",
}


def catalog_from_mapping(spark: SparkSession, sources: dict[str, str] | None) -> DataFrame:
    """A configured mapping of label to site; an empty one gives the default sites."""
    def text(x: object) -> str | None:
        return x if isinstance(x, str) else None

    schema = "label string, site_no string"
    given = [(text(label), text(site)) for label, site in (sources or {}).items()]
    usable = valid_catalog(spark.createDataFrame(given, schema))
    return spark.createDataFrame([*DEFAULT_SITES.items()], schema) if usable.isEmpty() else usable
