"""SQL that solves the normal equations of each group, for the checks of fitted coefficients."""

from __future__ import annotations

from collections.abc import Sequence


def normal_sums(y: str, xs: Sequence[str], penalty: float = 0.0) -> str:
    """Sums ``a_i_j`` and ``b_i`` of products of a leading one and ``xs`` with each other and with ``y``."""
    names = ["1.0::double", *xs]
    out = [
        f"sum({a} * {b}){f' + {penalty}' if penalty and i == j and i else ''} as a_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names)
    ]
    return ", ".join([*out, *(f"sum({a} * {y}) as b_{i}" for i, a in enumerate(names))])


def eliminate(source: str, keys: Sequence[str], p: int, name: str = "g", right: Sequence[str] = ("b",), kept: Sequence[str] = ()) -> str:
    """Tables ``g0`` to ``gp`` of Gauss-Jordan steps from ``source`` with ``a_i_j`` and right sides ``b_i``, and ``g`` with the
    solution ``b_i`` of each. ``kept`` columns go along."""
    steps, held = [], [*keys, *kept]
    before = source
    for k in range(p):
        cells = list(held)
        for i in range(p):
            factor = f"a_{i}_{k} / a_{k}_{k}"
            for j in range(k, p):
                cells.append(f"a_{i}_{j}" if i == k else f"a_{i}_{j} - {factor} * a_{k}_{j} as a_{i}_{j}")
            # pivots of earlier steps are asked for at the end
            if i < k:
                cells.append(f"a_{i}_{i}")
            for r in right:
                cells.append(f"{r}_{i}" if i == k else f"{r}_{i} - {factor} * {r}_{k} as {r}_{i}")
        steps.append(f"{name}{k} as (select {', '.join(cells)} from {before})")
        before = f"{name}{k}"
    last = [*held, *(f"{r}_{i} / a_{i}_{i} as {r}_{i}" for r in right for i in range(p))]
    return ",\n".join([*steps, f"{name} as (select {', '.join(last)} from {before})"])
