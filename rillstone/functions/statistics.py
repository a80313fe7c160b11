"""Statistics of groups, joined back to the rows they were taken from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import join_null_safe
from rillstone.functions.runtime import cut_lineage

#: Rows of statistics that are sent to every task; more groups than that are joined by a shuffle on many keys.
MOST_SENT = 50_000


def join_statistics(
    df: DataFrame, statistics: DataFrame, keys: Sequence[str], how: str = "inner", most: int = MOST_SENT
) -> DataFrame:
    """``df`` beside the statistics of its group; a null key matches a null key. The statistics are computed once
    and counted: few rows are sent to the tasks, so the rows of ``df`` stay where they are and a hot group moves
    nothing. With very many groups both sides are shuffled."""
    held = cut_lineage(statistics)
    few = held.count() <= most
    return join_null_safe(df, F.broadcast(held) if few else held, keys, how)
