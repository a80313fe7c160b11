"""Exact quantiles of many columns at once, by counting digits of numbers.

A double becomes an unsigned integer of the same order. The first scan counts its leading bits in every column, so that for
each wanted rank the digit is known that its value begins with; the next scans count only values with these beginnings.
After three scans all 64 bits are known. Tasks hold counts, never values, and hand them on when there are many; what the
driver gets is one digit for each column and rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Bits that a scan finds, from the first on.
DIGITS = (20, 22, 22)
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; NaN is the largest, as in Spark, and zeros are one number."""
    b = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(b & SIGN, ~b, b | SIGN)


def from_bits(b: int) -> float:
    u = np.array([b], np.uint64)
    return float(np.where(u & SIGN, u ^ SIGN, ~u).view(np.float64)[0])


def _summed(held: list[np.ndarray]) -> np.ndarray:
    """Columns of ``column, prefix, digit, n`` with equal ones added up."""
    every = np.concatenate(held, axis=1)
    every = every[:, np.lexsort(every[:3])]
    first = np.flatnonzero(np.append(True, (every[:3, 1:] != every[:3, :-1]).any(axis=0)))
    return np.concatenate((every[:3, first], [np.add.reduceat(every[3], first)]))


def _counts(df: DataFrame, wanted: dict[int, np.ndarray], done: int, bits: int) -> DataFrame:
    """``c, prefix, digit, n``: of the values of column number ``c`` that begin with one of its ``wanted`` prefixes of
    ``done`` bits, how many go on with each digit of ``bits``."""
    names = ["c", "prefix", "digit", "n"]

    def batch(held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)) for h in np.ascontiguousarray(held)], names)

    def run(batches):
        held, size = [], 0
        for rows in batches:
            for c, prefixes in wanted.items():
                key = ordered_bits(rows.column(c).drop_null().to_numpy(zero_copy_only=False))
                prefix = key >> np.uint64(64 - done) if done else np.zeros(len(key), np.uint64)
                near = np.isin(prefix, prefixes)
                digit = (key[near] << np.uint64(done)) >> np.uint64(64 - bits)
                for p in np.unique(prefix[near]):
                    digits, n = np.unique(digit[prefix[near] == p], return_counts=True)
                    held.append(np.stack((np.full(len(n), c, np.uint64), np.full(len(n), p), digits, n.astype(np.uint64))))
                    size += len(n)
            if size > HELD:
                held = [_summed(held)]
                size = held[0].shape[1]
                if size > HELD // 2:
                    yield batch(held[0])
                    held, size = [], 0
        if held:
            yield batch(_summed(held))

    found = df.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``column, q0, q1, ...``: exact quantiles of numeric columns with linear interpolation, nulls left out; a column
    without values has null ones."""
    spark = df.sparkSession
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # one entry for each column and rank: what is known of the value, and its rank among those that begin like it
    known: list[tuple[int, int, int, int]] = []
    totals: dict[int, int] = {}
    done = 0
    for scan, bits in enumerate(DIGITS):
        wanted = {c: np.array([0], np.uint64) for c in range(len(columns))} if not scan else {
            c: np.unique(np.array([p for k, _, p, _ in known if k == c], np.int64).view(np.uint64)) for c in sorted({k[0] for k in known})
        }
        if not wanted:
            break
        along = Window.partitionBy("c", "prefix").orderBy("digit")
        ranked = _counts(data, wanted, done, bits).withColumn("_to", F.sum("n").over(along))
        if not scan:
            ranked = ranked.withColumn("_all", F.sum("n").over(Window.partitionBy("c", "prefix")))
            places = [(F.col("_all") - 1) * F.lit(float(p)) for p in probs]
            ranks = F.array(*[end(place).cast("long") for place in places for end in (F.floor, F.ceil)])
        else:
            asked = spark.createDataFrame([(c, p, i, r) for c, i, p, r in known], "c long, prefix long, i int, r long")
            per = asked.groupBy("c", "prefix").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("_asked"))
            ranked = ranked.join(F.broadcast(per), ["c", "prefix"])  # one row for each column and rank at most
        # the digit of a rank is the first whose running count passes it
        entries = F.transform(ranks, lambda r, i: F.struct(i.alias("i"), r.alias("r"))) if not scan else F.col("_asked")
        hits = F.filter(entries, lambda e: (e["r"] < F.col("_to")) & (e["r"] >= F.col("_to") - F.col("n")))
        found = ranked.select("c", "prefix", "digit", (F.col("_to") - F.col("n")).alias("_from"), F.explode(hits).alias("e"), *([] if scan else ["_all"]))
        rows = found.select("c", "prefix", "digit", "e.i", (F.col("e.r") - F.col("_from")).alias("r"), *([] if scan else ["_all"])).collect()
        if not scan:
            totals = {r["c"]: r["_all"] for r in rows}
        known = [(r["c"], r["i"], _signed((r["prefix"] % 2**64) << bits | r["digit"]), r["r"]) for r in rows]
        done += bits
    values = {(c, i): from_bits(p % 2**64) for c, i, p, _ in known}
    out = []
    for c, name in enumerate(columns):
        line = []
        for i, p in enumerate(probs):
            if c not in totals:
                line.append(None)
                continue
            place = (totals[c] - 1) * float(p)
            low, high = values[c, 2 * i], values[c, 2 * i + 1]
            line.append(low if floor(place) == ceil(place) else low + (high - low) * (place - floor(place)))
        out.append((name, *line))
    return spark.createDataFrame(out, ", ".join(["column string", *(f"q{i} double" for i in range(len(probs)))]))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x
