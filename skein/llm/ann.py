"""Nearest neighbours with randomly rotated one-bit codes.

Unit vectors are rotated by a random orthonormal matrix of a fixed seed; a code is the signs of the result, packed to
bits, and one correction scalar f: the product of the rotated vector and its code's unit vector. For a query q the
product of code and q, divided by f, estimates the cosine; with the error factor ``eps`` its error is within
eps sqrt((1 - f^2) / f^2) / sqrt(dim - 1) but for a probability that falls as exp(-c eps^2).

Queries and vectors are packed into blocks, and each block of queries meets each block of vectors in one task: first the
candidates with the largest estimates are ranked exactly, which gives a floor; then every candidate whose upper bound
reaches the floor is. All scores returned are cosines of the original vectors in double precision. Equal vectors are
one candidate that carries its k + 1 smallest ids, which is all that any query can need of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.llm.vectors import blocks, cosines, longs, matrix, norms, record, valid

EPS, BLOCK, QUERIES, SEED = 2.5, 8192, 2048, 7
INDEX = "block int, dim int, uids binary, vectors binary, bits binary, factors binary"
CODES = pa.schema([(n, pa.int32() if t == "int" else pa.binary()) for n, t in map(str.split, INDEX.split(", "))])


@lru_cache(4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of the rows' directions."""
    turned = (x / norms(x)[:, None]) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def index(packed: DataFrame) -> DataFrame:
    """Adds ``bits`` and ``factors`` to blocks of vectors: the part of the search that can be stored and used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bits, factors = encode(matrix(r["vectors"], r["dim"]))
                yield pa.RecordBatch.from_pylist([r | {"bits": bits.tobytes(), "factors": factors.tobytes()}], CODES)

    return packed.mapInArrow(run, INDEX)


def nearest(q: np.ndarray, x: np.ndarray, bits: np.ndarray, factors: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the candidates that may be among its k nearest, at least the k nearest: rows, columns, cosines."""
    n, dim = x.shape
    qn, xn = norms(q), norms(x)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    signs /= (factors * np.sqrt(dim)).astype(np.float32)[:, None]
    width = (eps * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / np.sqrt(max(1, dim - 1))).astype(np.float32)
    turned = ((q / qn[:, None]) @ rotation(dim).T).astype(np.float32)
    rows, cols, scores = [], [], []
    for lo in range(0, len(q), 256):
        est = turned[lo : lo + 256] @ signs.T
        m = len(est)
        top = min(n, 4 * k)
        first = np.argpartition(-est, top - 1, axis=1)[:, :top]
        exact = cosines(q, x, qn, xn, np.repeat(np.arange(lo, lo + m), top), first.ravel()).reshape(m, top)
        floor = -np.sort(-exact, axis=1)[:, min(k, top) - 1]
        i, j = np.nonzero(est + width >= floor[:, None] - 1e-6)
        seen = np.zeros(est.shape, bool)
        seen[i, j] = True
        np.put_along_axis(seen, first, True, axis=1)
        i, j = np.nonzero(seen)
        c = cosines(q, x, qn, xn, i + lo, j)
        near = c >= floor[i]
        rows.append(i[near] + lo)
        cols.append(j[near])
        scores.append(c[near])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _search(k: int, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                dim = r["dim"]
                quids, uids = longs(r["quids"]), longs(r["uids"])
                bits = np.frombuffer(r["bits"], np.uint8).reshape(len(uids), -1)
                i, j, c = nearest(matrix(r["queries"], dim), matrix(r["vectors"], dim), bits, np.frombuffer(r["factors"]), k, eps)
                order = np.lexsort((-c, i))
                i, j, c = i[order], j[order], c[order]
                # ties with the k-th stay: which of them has the smaller ids is decided later
                begin = np.searchsorted(i, i)
                floor = c[np.minimum(begin + k - 1, np.searchsorted(i, i, "right") - 1)]
                on = c >= floor
                yield from record(["quid", "uid", "score"], [(quids[i[on]], uids[j[on]], c[on])])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding", eps: float = EPS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, id, score`` of the k nearest rows, by cosine, of each row for which ``is_query`` holds.

    A query's own id is no candidate of it; ties go to the smaller id. Vectors that are null, empty, zero or hold a null
    or non-finite component, and rows without an id, take no part, and vectors of another dimension than the query's are not its candidates. With
    fewer candidates than k all are returned. Rows repeated with one id count as one candidate, and as one query. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    few = rows.select("id", "vector").dropDuplicates().withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(f"nth <= {k + 1}")
    groups = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = stored(groups.withColumn("uid", F.monotonically_increasing_id()), "ann-distinct")
    asked = rows.where("asked").select("id", "vector").dropDuplicates()
    asked = stored(asked.join(groups.select("vector", "uid"), "vector").select(F.col("id").alias("query_id"), F.col("uid").alias("quid")), "ann-queries")
    wanted = asked.select("quid").distinct()
    queries = groups.join(wanted.select(F.col("quid").alias("uid")), "uid", "left_semi")
    n, m = max(1, -(-groups.count() // block)), max(1, -(-wanted.count() // QUERIES))
    one = F.lit(0).cast("long")
    codes = index(blocks(groups.select("uid", one.alias("e"), "vector"), n, "vector", "e"))
    dealt = blocks(queries.select("uid", one.alias("e"), "vector"), m, "vector", "e").select("dim", F.col("uids").alias("quids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    met = codes.join(dealt.hint("shuffle_hash"), ["block", "dim"]).mapInArrow(_search(k + 1, eps), "quid long, uid long, score double")
    ranked = met.join(groups.select("uid", F.explode("ids").alias("id")), "uid")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "id")
    ranked = ranked.withColumn("nth", F.row_number().over(order)).where(f"nth <= {k + 1}").select("quid", "id", "score")
    out = asked.join(ranked, "quid").where("query_id != id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(f"rank <= {k}")
    return out.select("query_id", "rank", F.col("id").alias(id_), "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0)
