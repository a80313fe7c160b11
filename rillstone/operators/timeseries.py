"""Robust scores, decomposition, stationarity, forecasts, lags and folds for many series.

Frames are one row per series and period (a day), so a window partition is bounded by the
calendar; aggregate raw readings first with ``features.daily_features``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.columns import join_null_safe
from rillstone.functions.quantiles import exact_quantiles
from rillstone.functions.statistics import join_statistics
from rillstone.operators.least_squares import cross_products, grouped_least_squares, solve_stack, square

# Fixed value: scales the median deviation to a normal deviation.
MAD_SCALE = 0.6745


def robust_z(df: DataFrame, value: str, by: Sequence[str], **options) -> DataFrame:
    """``0.6745 (x - median) / MAD`` per group; null where the MAD is zero."""
    middle = exact_quantiles(df, by, value, [0.5], **options).withColumnRenamed("q0", "_median")
    near = join_statistics(df, middle, by)
    apart = near.withColumn("_apart", F.abs(F.col(value) - F.col("_median")))
    mad = exact_quantiles(apart, by, "_apart", [0.5], **options).withColumnRenamed("q0", "_mad")
    scored = join_statistics(near, mad, by)
    z = F.try_divide(MAD_SCALE * (F.col(value) - F.col("_median")), F.col("_mad"))
    return scored.withColumn("robust_z", z).drop("_median", "_mad")


def _centred_mean(value: Column, along, period: int) -> Column:
    """Mean over one period around each row; null where it is incomplete. An even period has no row in its middle, so the
    two rows at its ends count half each."""
    half = period // 2
    around = along.rowsBetween(-half, half)
    full = F.count(value).over(around) == 2 * half + 1
    total = F.sum(value).over(around)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(along) + F.lead(value, half).over(along)) / 2
    return F.when(full, total / period)


def seasonal_decompose(
    df: DataFrame, value: str, series_keys: Sequence[str], order: str, period: int | Sequence[int] = 7
) -> DataFrame:
    """Additive parts of gap-free series. With one period: centred mean over the period as the trend (null where it is
    incomplete), mean detrended value per phase (made to average zero) as the season, and the rest. With several, shortest
    first, each season is taken out before the next is looked for: what is left after a season is the input of the next
    one; the trend is the one of the longest period. Columns are ``trend, phase, seasonal, residual`` for one period,
    ``trend, seasonal_<period>, ..., residual`` for several."""
    periods = [period] if isinstance(period, int) else sorted(set(period))
    if not periods or periods[0] < 2:
        raise ValueError("a period has at least 2 rows")
    along = Window.partitionBy(*series_keys).orderBy(order)
    out, left = df.withColumn("_left", F.col(value).cast("double")), F.col("_left")
    for p in periods:
        base = out.withColumns({"trend": _centred_mean(left, along, p), "phase": (F.row_number().over(along) - 1) % p})
        phases = base.groupBy(*series_keys, "phase").agg(F.avg(left - F.col("trend")).alias("_p"))
        # One row per phase: at most ``p`` rows in a window partition.
        centred = phases.select(
            *series_keys,
            "phase",
            (F.col("_p") - F.avg("_p").over(Window.partitionBy(*series_keys))).alias("seasonal"),
        )
        out = join_null_safe(base, centred, [*series_keys, "phase"], "left")
        if len(periods) > 1:
            out = out.withColumn("_left", left - F.col("seasonal")).withColumnRenamed("seasonal", f"seasonal_{p}").drop("phase")
    if len(periods) > 1:
        return out.withColumn("residual", left - F.col("trend")).drop("_left")
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_left")


def dickey_fuller(df: DataFrame, value: str, series_keys: Sequence[str], order: str, lags: int = 0) -> DataFrame:
    """Slope of the change on the level before it, its standard error and t-ratio, per series. With ``lags`` the
    changes before are explained too (the augmented test); a series whose columns depend on each other has nulls."""
    along = Window.partitionBy(*series_keys).orderBy(order)
    steps = df.withColumn("_x", F.lag(value).over(along)).withColumn("_y", F.col(value) - F.col("_x"))
    if lags:
        names = [f"_d{i}" for i in range(1, lags + 1)]
        steps = steps.withColumns({c: F.lag("_y", i).over(along) for i, c in enumerate(names, 1)})
        fit = grouped_least_squares(steps, series_keys, "_y", ["_x", *names])
        slope, error = F.get("coef", F.lit(1)), F.get("std_error", F.lit(1))
        return fit.select(
            *series_keys, "n", slope.alias("slope"), error.alias("std_error"), F.try_divide(slope, error).alias("t_stat")
        )
    fit = steps.groupBy(*series_keys).agg(
        F.regr_count("_y", "_x").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    )
    rest = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    error = F.sqrt(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("_sxx")))
    return fit.select(
        *series_keys,
        "n",
        "slope",
        error.alias("std_error"),
        F.try_divide(F.col("slope"), error).alias("t_stat"),
    )


def ar_forecast(
    df: DataFrame, value: str, series_keys: Sequence[str], order: str, lags: int = 3, horizon: int = 7
) -> DataFrame:
    """``series_keys, coef, step, forecast``: least-squares autoregression of each series and its forecast. Normal equations
    are sums in one grouped aggregate, so a series of any length becomes one row; those rows are solved in stacks. The
    forecast goes on from the newest row that has all its lags. A series of too few rows, or whose lags depend on each
    other, as a constant one, has no forecast."""
    along = Window.partitionBy(*series_keys).orderBy(order)
    names = [f"_l{i}" for i in range(1, lags + 1)]
    rows = df.withColumns({c: F.lag(value, i).over(along) for i, c in enumerate(names, 1)})
    sums = cross_products(rows, series_keys, value, names)
    state = [value, *names[: lags - 1]]
    newest = rows.dropna(subset=state).groupBy(*series_keys).agg(
        F.max_by(F.array(*[F.col(c).cast("double") for c in state]), order).alias("newest")
    )
    joined = join_null_safe(sums, newest, series_keys).filter(F.col("n") > lags + 1)
    p = lags + 1

    def solve(batches):
        for pdf in batches:
            coef, _, good = solve_stack(square(pdf["xx"], p), np.array(pdf["xy"].tolist(), float).reshape(-1, p))
            pdf, coef = pdf[good], coef[good]
            if not len(pdf):
                continue
            now = np.array(pdf["newest"].tolist(), float).reshape(-1, lags)
            path = np.empty((len(pdf), horizon))
            for k in range(horizon):
                path[:, k] = coef[:, 0] + np.einsum("gi,gi->g", coef[:, 1:], now)
                now = np.column_stack([path[:, k], now[:, :-1]])
            yield pdf[list(series_keys)].assign(coef=list(coef), path=list(path))

    keys = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in series_keys)
    solved = joined.mapInPandas(solve, f"{keys}coef array<double>, path array<double>")
    return solved.select(
        *series_keys, "coef", F.posexplode("path").alias("step", "forecast")
    ).withColumn("step", F.col("step") + 1)


def ar1_fit(df: DataFrame, value: str, series_keys: Sequence[str], order: str) -> DataFrame:
    """First-order case in built-in aggregates: slope, intercept, next value."""
    along = Window.partitionBy(*series_keys).orderBy(order)
    rows = df.withColumn("_x", F.lag(value).over(along))
    fit = rows.groupBy(*series_keys).agg(
        F.regr_slope(value, "_x").alias("slope"),
        F.regr_intercept(value, "_x").alias("intercept"),
        F.max_by(value, order).alias("_last"),
    )
    return fit.select(
        *series_keys, "slope", "intercept", (F.col("intercept") + F.col("slope") * F.col("_last")).alias("forecast")
    )


def lag_rolling_features(
    df: DataFrame,
    value: str,
    series_keys: Sequence[str],
    order: str,
    lags: Sequence[int] = (1, 7),
    windows: Sequence[int] = (7,),
) -> DataFrame:
    """Lags, and statistics of the rows before the current one, so no row sees its own value."""
    along = Window.partitionBy(*series_keys).orderBy(order)
    out = {f"{value}_lag{n}": F.lag(value, n).over(along) for n in lags}
    for w in windows:
        frame = along.rowsBetween(-w, -1)
        out[f"{value}_mean{w}"] = F.avg(value).over(frame)
        out[f"{value}_min{w}"] = F.min(value).over(frame)
        out[f"{value}_max{w}"] = F.max(value).over(frame)
    return df.withColumns(out)


def temporal_folds(
    df: DataFrame, time_col: str, folds: int = 4, kind: str = "expanding"
) -> DataFrame:
    """Time-ordered train and test rows. The span is cut into ``folds + 1`` equal parts; fold k
    tests part k and trains on the part before it (rolling) or on all before it (expanding).
    Each row is copied to the folds it serves, by an array of its folds: no join."""
    if kind not in ("expanding", "rolling"):
        raise ValueError("kind is 'expanding' or 'rolling'")
    ends = df.agg(F.struct(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))).scalar()
    span = F.timestamp_diff("MICROSECOND", ends.getField("lo"), ends.getField("hi"))
    since = F.timestamp_diff("MICROSECOND", ends.getField("lo"), F.col(time_col))
    part = F.least(
        F.coalesce(F.try_divide(since * (folds + 1), span), F.lit(0.0)).cast("int"), F.lit(folds)
    )
    placed = df.withColumn("_part", part)
    first, last = F.greatest(F.col("_part"), F.lit(1)), F.lit(folds)
    if kind == "rolling":
        last = F.least(F.col("_part") + 1, F.lit(folds))
    return placed.select(
        "*", F.explode(F.sequence(first, last)).alias("fold")
    ).select(
        *[c for c in df.columns],
        "fold",
        F.when(F.col("_part") == F.col("fold"), "test").otherwise("train").alias("role"),
    )


