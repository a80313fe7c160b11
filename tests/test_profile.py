from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rillstone.functions.ordered import running_totals
from rillstone.functions.quantiles import exact_quantiles
from rillstone.operators import profile, shape
from tests.conftest import rows


@pytest.fixture(scope="module")
def minerals(spark):
    data = [("UT", "vein", 1.0), ("UT", None, 2.0), (None, "", 3.0), ("CO", "vein", None), ("AZ", "pipe", 10.0)]
    return spark.createDataFrame(data, "state string, dep_type string, latitude double").withColumn(
        "longitude", F.lit(None).cast("double")
    )


def test_counts_keep_the_null_group(minerals):
    got = [tuple(r) for r in profile.count_by(minerals, "state").collect()]
    assert got == [("UT", 2), (None, 1), ("AZ", 1), ("CO", 1)]
    assert sum(n for _, n in got) == minerals.count()


def test_missing_labels(minerals):
    plain = dict(rows(profile.count_by(minerals, "dep_type", True)))
    blank = dict(rows(profile.count_by(minerals, "dep_type", True, True)))
    assert plain == {"vein": 2, "<missing>": 1, "": 1, "pipe": 1}
    assert blank == {"vein": 2, "<missing>": 2, "pipe": 1}
    assert shape.label_missing(minerals, "dep_type").filter("dep_type = '<missing>'").count() == 1


def test_numeric_summary(minerals):
    got = {(r[0], r[1]): r[2] for r in rows(profile.numeric_summary(minerals))}
    assert got[("latitude", "count")] == 4 and got[("latitude", "50%")] == 2.5 and got[("latitude", "max")] == 10
    assert got[("latitude", "std")] == pytest.approx(np.std([1, 2, 3, 10], ddof=1))
    assert got[("longitude", "count")] == 0 and got[("longitude", "mean")] is None
    assert len(got) == 16
    with pytest.raises(ValueError):
        profile.numeric_summary(minerals, method="guess")
    assert profile.numeric_summary(minerals, method="approx").count() == 16


def test_six_numbers(minerals):
    got = profile.six_number_summary(minerals).filter("column = 'latitude'").first()
    assert (got["min"], got["first_quartile"], got["median"], got["mean"]) == (1.0, 1.75, 2.5, 4.0)
    assert got["n_null"] == 1


def test_describe(spark, minerals):
    df = minerals.withColumn("at", F.lit("2020-01-02").cast("timestamp_ntz")).withColumn("n", F.lit(1))
    got = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert got["state"]["unique"] == 3 and got["state"]["top"] == "UT" and got["state"]["freq"] == 2
    assert got["at"]["kind"] == "time" and got["at"]["q50_time"].day == 2 and got["at"]["mean"] is None
    assert got["n"]["mean"] == 1.0 and got["latitude"]["count"] == 4
    flags = spark.createDataFrame([(True, None, b"x"), (False, None, b"x"), (True, None, b"x"), (None, None, b"x")], "a boolean, b boolean, c binary")
    told = {r["column"]: r for r in profile.describe_all(flags).collect()}
    assert (told["a"]["kind"], told["a"]["count"], told["a"]["unique"], told["a"]["top"], told["a"]["freq"]) == ("boolean", 3, 2, "true", 2)
    assert profile.describe_all(flags.select("c")).collect() == [] and "c" not in told
    tie = profile.describe_all(spark.createDataFrame([("b",), ("a",)], "s string")).first()
    assert tie["top"] == "a"


def test_distinct_and_overview(minerals):
    got = rows(profile.distinct_sorted(minerals, "state", 2))
    assert got == [("AZ", 3), ("CO", 3)]
    report = rows(profile.dataset_overview(minerals))
    assert ("rows", "5") in report and ("states", "3") in report and ("dep_types", "3") in report
    assert [v for k, v in report if k == "state"] == ["AZ", "CO", "UT"]


def test_row_views(spark):
    df = spark.range(100).withColumn("t", (F.col("id") * 7) % 100).withColumn("s", F.col("id") % 3)
    assert [r["t"] for r in profile.head_n(df, 3, "t").collect()] == [0, 1, 2]
    assert [r["t"] for r in profile.tail_n(df, 3, "t").collect()] == [97, 98, 99]
    assert profile.tail_n_per_series(df, 4, ["s"], "t").count() == 12
    assert profile.top_n(df, "t", 2).count() == 2
    some = {r["id"] for r in profile.sample_n(df, 10, "id").collect()}
    assert some == {r["id"] for r in profile.sample_n(df.repartition(7), 10, "id").collect()}
    assert len(some) == 10 and profile.sample_n(df, 1000, "id").count() == 100


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.floats(-1e3, 1e3), st.sampled_from([0.0, 1.0, 1.0, 2.0])), min_size=1, max_size=200),
    p=st.floats(0, 1),
)
def test_bracketed_quantiles_are_exact(spark, values, p):
    df = spark.createDataFrame([("g" if i % 2 else None, v) for i, v in enumerate(values)], "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, ["g"], "v", [p, 0.5], small_group=0, accuracy=50).collect()}
    for g in {"g" if i % 2 else None for i in range(len(values))}:
        mine = [v for i, v in enumerate(values) if ("g" if i % 2 else None) == g]
        assert got[g] == pytest.approx(tuple(np.quantile(mine, [p, 0.5])), rel=1e-9, abs=1e-9)


def test_bracketed_quantiles_of_a_large_hot_group(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
        F.when(F.col("id") % 3 == 1, F.lit(5.0)).otherwise((F.col("id") * 7919 % 60_013).cast("double")).alias("v"),
    )
    probs = [0.01, 0.25, 0.5, 0.75, 0.999]
    exact = rows(exact_quantiles(df, ["g"], "v", probs))
    assert rows(exact_quantiles(df, ["g"], "v", probs, small_group=10, accuracy=1000)) == exact
    whole = rows(exact_quantiles(df, [], "v", probs))
    assert rows(exact_quantiles(df, [], "v", probs, small_group=10, accuracy=1000)) == whole


def test_two_level_running_totals(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("g"), (F.col("id") * 31 % 503).cast("double").alias("x"), F.lit(1).alias("n"))
    for keys in ([], ["g"]):
        for down in (False, True):
            got = running_totals(df, keys, "x", ["n"], down, rows_per_chunk=20).collect()
            sets = {}
            for r in got:
                sets.setdefault(r["g"] if keys else 0, []).append(r)
            for part in sets.values():
                part.sort(key=lambda r: r["x"], reverse=down)
                assert [r["cum_n"] for r in part] == list(range(1, len(part) + 1))
