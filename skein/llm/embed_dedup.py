"""Near-duplicate vectors: int8 tile products with rigorous error bounds, and full precision where they cannot decide.

Equal vectors are collapsed first, so a vector with any number of copies is compared once. Distinct vectors are hashed
to blocks; every pair of blocks is a tile, one task's work. A unit vector u has codes q and a scale d, and e = |u - d q|.
By Cauchy-Schwarz the product of u and v differs from d d' q.q' by at most e + (1 + e) e'. q.q' is exact: sums of int8
products stay below 2^24 in single precision up to 1040 dimensions, and double precision serves beyond. A pair that the
bound puts below the threshold ends there; any other is recomputed in double precision from the original vectors.

A tile returns for each of its linked vectors how many it links with and the least number in its connected component
there, not the pairs: output stays linear in a tile's rows also where all are near copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.llm.components import connected_components
from skein.llm.vectors import blocks, cosines, longs, matrix, norms, record, valid

THRESHOLD, TILE, STRIP = 0.95, 4096, 512
#: Covers the rounding of the bounds themselves.
SLACK = 1e-6


class Codes:
    """One block, quantised: codes, scales and error bounds of its unit vectors."""

    def __init__(self, raw: dict) -> None:
        dim = raw["dim"]
        self.uids, self.copies, self.x = longs(raw["uids"]), longs(raw["extra"]), matrix(raw["vectors"], dim)
        self.norms = norms(self.x)
        unit = self.x / self.norms[:, None]
        self.scale = np.abs(unit).max(1) / 127
        q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = norms(unit - q * self.scale[:, None]) + SLACK
        self.q = q.astype(np.float32 if dim <= 1040 else np.float64)


def tile_pairs(a: Codes, b: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the linked pairs of two blocks, strip by strip; of a block with itself each pair once."""
    far, wide = b.error.max(), b.scale.max()
    for lo in range(0, len(a.uids), STRIP):
        s = slice(lo, lo + STRIP)
        least = (threshold - a.error[s] - (1 + a.error[s]) * far) / (a.scale[s] * wide)
        dots = a.q[s] @ (b.q[lo:] if same else b.q).T
        i, j = np.nonzero(dots >= np.where(least > 0, least, -np.inf)[:, None])
        close = dots[i, j]
        i, j = i + lo, j + lo * same
        if same:
            i, j, close = (x[i < j] for x in (i, j, close)) if len(i) else (i, j, close)
        maybe = close * a.scale[i] * b.scale[j] + a.error[i] + (1 + a.error[i]) * b.error[j] >= threshold
        i, j = i[maybe], j[maybe]
        sure = cosines(a.x, b.x, a.norms, b.norms, i, j) >= threshold
        yield i[sure], j[sure]


def labels(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each node's component: labels spread over the pairs and jump until they are stable."""
    label = np.arange(n)
    while True:
        old = label.copy()
        for i, j in pairs:
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
        label = label[label]
        if (label == old).all():
            return label


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        a = Codes(rows[0])
        b = Codes(rows[1]) if len(rows) > 1 else a
        same, n = len(rows) == 1, len(a.uids)
        uids = a.uids if same else np.concatenate([a.uids, b.uids])
        order = np.argsort(uids, kind="stable")
        rank = np.empty(len(uids), np.int64)
        rank[order] = np.arange(len(uids))
        links, pairs = np.zeros(len(uids), np.int64), []
        if rows[0]["lo"] == rows[0]["hi"] or not same:
            for i, j in tile_pairs(a, b, threshold, same):
                k = j + n * (not same)
                links += np.bincount(i, b.copies[j], len(uids)).astype(np.int64) + np.bincount(k, a.copies[i], len(uids)).astype(np.int64)
                pairs.append((rank[i], rank[k]))
        least = uids[order][labels(len(uids), pairs)[rank]]
        on = links > 0
        return pa.table({"uid": uids[on], "links": links[on], "least": least[on]})

    return run


def near_duplicates(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row for each row of vectors: ``id, n_links, component_id, kept``.

    Rows are linked when the cosine of their vectors, in double precision, is at least ``threshold``; n_links counts the
    other rows linked directly, component_id is the smallest id reachable and kept says whether that is the row's own.
    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, and so do vectors of
    different dimensions. Repeated rows are vectors of their own and link. An empty table gives an empty result. Other
    columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).withColumn("ok", valid(F.col("vector")))
    good = rows.where("ok").select("id", F.transform("vector", lambda x: x + F.lit(0).cast("float")).alias("vector"))
    groups = good.groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    groups = stored(groups.withColumn("uid", F.monotonically_increasing_id()), "vectors-distinct")
    n = max(1, -(-groups.count() // tile))
    packed = blocks(groups, n, "vector", "copies")
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    grid = packed.select("*", others).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = grid.groupBy("dim", "lo", "hi").applyInArrow(_tile(threshold), "uid long, links long, least long")
    found = stored(found, "vectors-links")
    cc = connected_components(found.select(F.col("uid").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    of = groups.join(links, "uid", "left").join(cc.withColumnRenamed("node", "uid"), "uid", "left")
    of = of.select("vector", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "uid").alias("label"))
    first = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = of.join(first, "label").select("vector", "n_links", "component_id")
    linked = good.join(of, "vector").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embed_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
