"""Least squares of many groups at once: sums of products in one aggregate, small systems solved in stacks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def cross_products(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """``keys, n, xx, xy, yy`` of rows without a null: sums of products with a leading one, so a group of any size is one
    row. Products of the same two columns are summed once."""
    names = ["_one", *xs]
    full = df.withColumn("_one", F.lit(1.0)).dropna(subset=[y, *xs])
    upper = [F.sum(F.col(a).cast("double") * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    right = [F.sum(F.col(a).cast("double") * F.col(y)) for a in names]
    return full.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*upper).alias("xx"), F.array(*right).alias("xy"),
        F.sum(F.col(y).cast("double") * F.col(y)).alias("yy"),
    )


def solve_stack(
    xx: np.ndarray, xy: np.ndarray, penalty: float = 0.0, tolerance: float = 1e-11
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, the diagonal of the inverse, and which systems can be solved, for stacks of full matrices. Columns are
    scaled to length one first; a system whose scaled matrix lacks rank has no solution. The penalty is on all but the first."""
    p = xx.shape[1]
    xx = xx + penalty * np.diag([0.0, *[1.0] * (p - 1)])
    size = np.sqrt(np.einsum("gii->gi", xx))
    safe = np.where(size > 0, size, 1.0)
    scaled = xx / safe[:, :, None] / safe[:, None, :]
    good = np.isfinite(scaled).all(axis=(1, 2)) & np.isfinite(xy).all(axis=1)
    good[good] = np.linalg.matrix_rank(scaled[good], tol=tolerance, hermitian=True) == p
    coef, spread = np.full(xy.shape, np.nan), np.full(xy.shape, np.nan)
    if good.any():
        inverse = np.linalg.inv(scaled[good])
        coef[good] = np.linalg.solve(scaled[good], (xy / safe)[good][..., None])[..., 0] / safe[good]
        spread[good] = np.einsum("gii->gi", inverse) / safe[good] ** 2
    return coef, spread, good


def square(upper: pd.Series, p: int) -> np.ndarray:
    """Full matrices of rows of upper triangles."""
    flat = np.array(upper.tolist(), float).reshape(len(upper), -1)
    out = np.zeros((len(upper), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = out[:, j, i] = flat
    return out


def grouped_least_squares(
    df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], penalty: float = 0.0
) -> DataFrame:
    """``keys, n, coef, std_error, sse, collinear`` of each group: the intercept first. With a ``penalty`` it is ridge
    regression and has no errors. A group whose columns depend on each other, or with fewer rows than columns, is
    ``collinear`` and has nulls."""
    p = len(xs) + 1
    sums = cross_products(df, keys, y, xs)
    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            coef, spread, good = solve_stack(square(rows["xx"], p), np.array(rows["xy"].tolist(), float).reshape(-1, p), penalty)
            xy, n = np.array(rows["xy"].tolist(), float).reshape(-1, p), rows["n"].to_numpy()
            good &= n >= p
            sse = np.maximum(0.0, rows["yy"].to_numpy() - np.einsum("gi,gi->g", np.nan_to_num(coef), xy))
            with np.errstate(all="ignore"):
                error = np.sqrt(spread * np.where(n > p, sse / (n - p), np.nan)[:, None])
            yield rows[[*keys, "n"]].assign(
                coef=[c.tolist() if g else None for c, g in zip(coef, good, strict=True)],
                std_error=[e.tolist() if g and k > p and not penalty else None for e, g, k in zip(error, good, n, strict=True)],
                sse=np.where(good & (penalty == 0), sse, np.nan), collinear=~good,
            )

    solved = sums.mapInPandas(run, f"{names + ', ' if keys else ''}n long, coef array<double>, std_error array<double>, sse double, collinear boolean")
    return solved.withColumn("sse", F.nanvl("sse", F.lit(None).cast("double")))
