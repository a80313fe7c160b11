"""Near-duplicate embeddings by binary codes of randomly rotated vectors.

Each unit vector is rotated at random, as often as it takes for ``BITS`` bits, and kept as signs plus one correction
factor, the inner product of the rotated vector with its own code. The ratio of inner products is then an unbiased
estimate of a cosine, with a known bound on its error; pairs whose bound reaches the threshold are recomputed in double
precision, all others are not.
Candidates share a band of sign bits under one of many rotations, and their codes differ in no more bits than those of a
pair at the threshold may, with five standard deviations for chance. The width of a band follows the number of vectors,
and the number of bands follows from the width, so that the chance that a pair at the threshold shares no band
is at most ``miss``, at every size.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of
different lengths never link. Every row is a vector: equal vectors count as links of each other, also under one
``vec_id``. Rows without ``vec_id`` link with nothing and are kept.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.llm.blocks import bucket_edges, each_group, paired_blocks, sides, spanning, written
from rillstone.llm.textbytes import mix
from rillstone.operators.graphs import connected_components


#: Bits of a code, or one for each dimension if there are more.
BITS = 512


def bands(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits in a band and number of bands: few random vectors share a band, a pair at the threshold nearly always."""
    width = max(12, math.ceil(math.log2(max(rows, 1))) + 2)
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log1p(-same))


@lru_cache(maxsize=256)
def rotation(number: int, dims: int) -> np.ndarray:
    """A random rotation that is the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([number % 2**32, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def turning(dims: int) -> np.ndarray:
    """The rotations of a code side by side, scaled so that lengths stay."""
    times = max(1, -(-BITS // dims))
    return np.concatenate([rotation(-1 - k, dims) for k in range(times)], axis=1) / math.sqrt(times)


def bits_apart(threshold: float, dims: int) -> int:
    """In how many bits the codes of a pair at the threshold differ, with five standard deviations for chance."""
    n, p = turning(dims).shape[1], math.acos(threshold) / math.pi
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _keys(unit: np.ndarray, width: int, count: int) -> np.ndarray:
    """Sign bits under as many rotations as the bands need; a band's number is part of its key."""
    n, dims = unit.shape
    need = math.ceil(width * count / dims)
    out, held, band = np.empty((n, count), np.uint64), np.empty((n, 0), np.uint8), 0
    for r in range(need):
        held = np.concatenate((held, (unit @ rotation(r + 1, dims) > 0).astype(np.uint8)), axis=1)
        while held.shape[1] >= width and band < count:
            word = np.packbits(held[:, :width], axis=1)
            h = mix(np.full(n, band + 1, np.uint64))  # so that no band has the keys of another
            for k in range(word.shape[1]):
                h = mix(h ^ word[:, k].astype(np.uint64), k + dims)
            out[:, band], held, band = h, held[:, width:], band + 1
    return out.view(np.int64)


def encode(vectors: DataFrame, width: int, count: int) -> DataFrame:
    """``node, dims, unit, code, factor, keys`` of each ``(node, embedding)`` with a direction: the unit vector as
    doubles and the code as bits, both as bytes, and the correction factor."""

    def run(batches):
        for rows in batches:
            good = [v is not None and len(v) > 0 for v in rows["embedding"]]
            rows = rows[good]
            sizes = rows["embedding"].map(len)
            for dims, part in rows.groupby(sizes):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part["embedding"]])
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(axis=1, keepdims=True)
                    x = x / top
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                ok = np.isfinite(x).all(axis=1) & np.isfinite(top[:, 0])
                x, part = x[ok], part[ok]
                if not len(x):
                    continue
                turned = x @ turning(dims)
                yield pd.DataFrame({
                    "node": part["node"].to_numpy(), "dims": dims, "unit": [v.tobytes() for v in x],
                    "code": [v.tobytes() for v in np.packbits(turned > 0, axis=1)],
                    "factor": np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1]),
                    "keys": list(_keys(x, width, count)),
                })

    return vectors.mapInPandas(run, "node long, dims int, unit binary, code binary, factor double, keys array<long>")


def _words(codes: pd.Series) -> np.ndarray:
    """Codes as rows of 64-bit words; codes of one length are padded alike."""
    size = len(codes.iloc[0])
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), size)
    return np.pad(raw, ((0, 0), (0, -size % 8))).view(np.uint64)


def _signs(codes: pd.Series, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return (np.unpackbits(raw, axis=1)[:, :bits].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(bits))


def _units(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), dims)


def upper_bound(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, sigmas: float) -> np.ndarray:
    """Upper confidence bounds of cosines: codes in rows against rotated vectors in columns."""
    estimate = (signs @ turned.T) / factor[:, None]
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(signs.shape[1] - 1, 1))
    return estimate + (sigmas * spread)[:, None]


def _cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """All inner products; those too near the threshold for a matrix product to decide are summed one by one."""
    out = a @ b.T
    x, y = np.nonzero(np.abs(out - threshold) < 1e-9)
    for k in range(0, len(x), 65536):
        i, j = x[k : k + 65536], y[k : k + 65536]
        out[i, j] = np.einsum("ij,ij->i", a[i], b[j])
    return out


def embedding_duplicates(
    vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-5, sigmas: float = 5.0, per_block: int = 512
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    width, count = bands(source.count(), threshold, miss)
    # equal vectors are one node with a weight
    classes = written(
        source.filter("vec_id IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    coded = written(encode(classes.select("node", "embedding"), width, count), "codes")

    def near(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        words, dims = _words(rows["code"]), int(rows["dims"].iloc[0])  # the number of dimensions is part of a key
        apart = np.zeros((len(left), len(right)), np.uint16)
        for k in range(words.shape[1]):
            apart += np.bitwise_count(words[left, k][:, None] ^ words[right, k][None, :])
        return apart <= bits_apart(threshold, dims)

    def near_pairs(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        for dims in rows["dims_u"].unique().tolist():
            at = np.flatnonzero((rows["dims_u"] == dims) & (rows["dims_v"] == dims))
            apart = np.bitwise_count(_words(rows["code_u"].iloc[at]) ^ _words(rows["code_v"].iloc[at])).sum(axis=1)
            out[at] = apart <= bits_apart(threshold, dims)
        return out

    candidates = bucket_edges(
        coded.select("node", "keys"), coded.select("node", "dims", "code"), near, near_pairs, per_block, few=8
    )
    clusters = written(connected_components(written(candidates, "candidates")), "clusters")
    features = coded.select("node", "dims", "unit", "code", "factor")
    full = clusters.join(features, "node").join(classes.select("node", "weight"), "node")
    # vectors within half the angle of the smallest of their cluster link with each other: no pair of them is compared
    centre = clusters.select("component").distinct().join(
        features.select(F.col("node").alias("component"), F.col("unit").alias("_centre"), F.col("dims").alias("_dims")), "component"
    )
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def far(batches):
        for rows in batches:
            out = np.ones(len(rows), bool)
            for dims in rows["dims"].unique():
                at = np.flatnonzero((rows["dims"] == dims) & (rows["_dims"] == dims))
                a, b = _units(rows["unit"].iloc[at], dims), _units(rows["_centre"].iloc[at], dims)
                out[at] = np.einsum("ij,ij->i", a, b) < half
            yield rows.drop(columns=["_centre", "_dims"]).assign(_open=out)

    full = written(
        full.join(centre, "component").mapInPandas(
            far, "node long, component long, dims int, unit binary, code binary, factor double, weight long, _open boolean"
        ),
        "members",
    )
    core = full.filter("NOT _open").groupBy("component").agg(F.sum("weight").alias("_all"))
    inside = full.filter("NOT _open").join(core, "component").select(
        "node", (F.col("_all") - F.col("weight")).alias("links"), F.col("component").alias("other")
    )

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        """One row for each vector with links: how many, and an edge for each step of a spanning forest."""
        left, right = sides(rows)
        node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
        alone = rows["_i"].iloc[0] == rows["_j"].iloc[0]
        links, linked = np.zeros(len(rows), np.int64), np.zeros((len(rows), len(rows)), bool)
        for dims in rows["dims"].unique().tolist():
            i, j = (side[rows["dims"].to_numpy()[side] == dims] for side in (left, right))
            if not len(i) or not len(j):
                continue
            a, b = _units(rows["unit"].iloc[i], dims), _units(rows["unit"].iloc[j], dims)
            turned = (b @ turning(dims)).astype(np.float32)
            likely = upper_bound(_signs(rows["code"].iloc[i], turned.shape[1]), rows["factor"].to_numpy()[i], turned, sigmas) >= threshold
            # rows and columns without a likely pair are left out of the exact product
            p, q = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
            linked[np.ix_(i[p], j[q])] = likely[np.ix_(p, q)] & (_cosines(a[p], b[q], threshold) >= threshold)
        if alone:  # a bound may let a pair through in one direction only
            linked |= linked.T
            np.fill_diagonal(linked, False)
            links += linked.astype(np.int64) @ weight
        else:
            links += linked.astype(np.int64) @ weight + linked.T.astype(np.int64) @ weight
        x, y = spanning(linked | linked.T)
        u, v = node[x], node[y]
        counted = np.flatnonzero(links)
        return pd.DataFrame({
            "node": np.concatenate((node[counted], u)), "links": np.concatenate((links[counted], np.zeros(len(u), np.int64))),
            "other": pd.array(np.concatenate((node[counted], v)), dtype="Int64"),
        })

    found = written(
        each_group(
            paired_blocks(full, "component", "node", per_block), ["component", "_i", "_j"], confirm, "node long, links long, other long"
        ).unionByName(inside),
        "links",
    )
    edges = found.filter("node != other").select(F.col("node").alias("u"), F.col("other").alias("v"))
    joined = connected_components(edges).select("node", F.col("component").alias("_c"))
    links = found.groupBy("node").agg(F.sum("links").alias("_links"))
    per_class = (
        classes.join(coded.select("node", F.lit(True).alias("_ok")), "node", "left").join(links, "node", "left")
        .join(joined, "node", "left")
        .select("embedding", "first", "weight", "_ok", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_c", "node").alias("_c"))
    )
    smallest = per_class.groupBy("_c").agg(F.min("first").alias("_smallest"))
    per_class = per_class.join(smallest, "_c").select(
        F.col("embedding").alias("_e"), "_smallest", "_ok",
        (F.col("_links") + F.col("weight") - 1).alias("_n"),
    )
    own = F.col("vec_id").isNotNull() & F.col("embedding").eqNullSafe(F.col("_e"))
    return source.join(per_class, own, "left").select(
        "vec_id", F.when(F.col("_ok"), F.col("_n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_ok"), F.col("_smallest")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
