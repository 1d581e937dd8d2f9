"""Vectors shared by the search and the near-duplicate operator: validity, distinct vectors, blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block: ids are the caller's numbers of the distinct vectors, vectors little-endian doubles.
BLOCK = "block int, dim int, uids binary, extra binary, vectors binary"


def valid(vector: Column) -> Column:
    """Not null, not empty, all components finite, a norm over zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(vector.isNotNull() & finite & (norm > 0) & (norm < float("inf")), F.lit(False))


def blocks(df: DataFrame, blocks_: int, vector: str, extra: str) -> DataFrame:
    """Packs ``uid, extra (long), vector`` rows into ``blocks_`` blocks of about equal size, one row for each and dimension.

    The block is a hash of uid, so its size is bounded by the rows a block was planned for, whatever the data.
    """
    dealt = df.select(F.pmod(F.xxhash64("uid"), F.lit(blocks_)).cast("int").alias("block"), F.size(vector).alias("dim"), "uid", F.col(extra).cast("long").alias("extra"), F.col(vector).cast("array<double>").alias("vector"))

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table["uid"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["vector"].chunks])
        values = [table["block"][0].as_py(), table["dim"][0].as_py(), *(table[c].to_numpy().astype("<i8").tobytes() for c in ("uid", "extra")), flat.astype("<f8").tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "dim", "uids", "extra", "vectors"])

    return dealt.groupBy("block", "dim").applyInArrow(one, BLOCK)


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosines(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Cosines, in double precision, of the rows i of x and j of y, pair by pair."""
    out = np.empty(len(i))
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        out[lo : lo + step] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
    return out


def record(names: list[str], rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)
