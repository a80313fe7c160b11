"""Quantiles by digits against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.functions import radix


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    bits = radix.ordered_bits(x)
    assert (bits[1:] > bits[:-1]).all() and radix.ordered_bits(np.array([-0.0])) == radix.ordered_bits(np.array([0.0]))
    assert [radix.from_bits(int(b)) for b in bits[:-1]] == x[:-1].tolist() and np.isnan(radix.from_bits(int(bits[-1])))


@pytest.mark.parametrize("held", [radix.HELD, 50])
def test_quantiles_of_columns(spark, monkeypatch, held):
    monkeypatch.setattr(radix, "HELD", held)
    r = np.random.default_rng(7)
    n = 3000
    columns = {
        "normal": r.normal(size=n), "wide": np.exp(r.normal(0, 60, size=n)) * r.choice([-1, 1], n), "one": np.full(n, 3.25),
        "few": r.integers(-2, 3, n).astype(float), "close": 1 + r.integers(0, 50, n) * 2.0**-52, "holes": r.normal(size=n), "none": np.full(n, np.nan),
    }
    gone = {"holes": r.random(n) < 0.4, "none": np.ones(n, bool)}
    cells = [[None if k in gone and gone[k][i] else float(v[i]) for k, v in columns.items()] for i in range(n)]
    df = spark.createDataFrame(cells, ", ".join(f"`{k}.x` double" for k in columns)).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {x[0]: list(x[1:]) for x in radix.column_quantiles(df, df.columns, probs).collect()}
    for k, v in columns.items():
        v = v[~gone[k]] if k in gone else v
        assert got[f"{k}.x"] == ([None] * len(probs) if not len(v) else pytest.approx([float(np.quantile(v, p)) for p in probs], rel=1e-12))
    assert radix.column_quantiles(df.limit(0), df.columns, [0.5]).collect()[0][1] is None


def test_many_columns_hold_no_values(spark):
    """Two hundred columns of two million rows: a task gives out counts, far fewer than the values."""
    df = spark.range(0, 2_000_000, numPartitions=8).select(*[((F.col("id") * (i + 3)) % 1009).cast("double").alias(f"c{i}") for i in range(200)])
    counts = radix._counts(df.select("c0", "c7"), {0: np.array([0], np.uint64), 1: np.array([0], np.uint64)}, 0, radix.DIGITS[0])
    assert counts.count() <= 2 * 1009
    got = radix.column_quantiles(df, df.columns, [0.5]).collect()
    assert len(got) == 200 and all(abs(x["q0"] - 504) <= 1 for x in got)
