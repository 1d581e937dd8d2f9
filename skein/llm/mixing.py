"""Mixing sources to target weights by proportionate-fair scheduling.

A source's documents are numbered and cut into blocks. Weights are exact fractions w that sum to 1. Block i (from 1) of a
source is released at slot floor((i - 1) / w) and due by slot ceil(i / w); in each slot the released block with the
earliest deadline goes. At any time each source then has had its target share of the slots to within less than one block.
When a source has no block left, the others go on from there by their remaining weights: no document is dropped or repeated.

The schedule is made on the driver, from one number for each source. A block has ``block`` documents, or more where the
corpus would need over ``slots`` blocks of that size: the schedule and what is broadcast stay below that many rows at any
size. A source's documents are ranked in salted groups plus the groups' totals, so a source of any size is ranked in many
tasks; a rank gives the block, and a join with the schedule the place. All of it is column expressions.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import salt

BLOCK, SLOTS, ALPHA = 16, 1 << 18, 0.5


def fraction(weight: float | str | Fraction) -> Fraction:
    """A float is the decimal fraction that it prints as: 0.1 is one tenth."""
    return weight if isinstance(weight, Fraction) else Fraction(str(weight))


def exact(weights: Mapping[str, float | Fraction]) -> dict[str, Fraction]:
    """Shares of 1."""
    parts = {s: fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in parts.values()):
        raise ValueError("weights must be positive")
    total = sum(parts.values())
    return {s: w / total for s, w in parts.items()}


def schedule(shares: Mapping[str, Fraction], blocks: Mapping[str, int]) -> list[str]:
    """The source of each slot until one of them has had all its ``blocks``; ties of deadlines go by name."""
    waiting = [(0, s) for s in sorted(shares)]  # by release
    due: list[tuple[int, str]] = []
    had, out = dict.fromkeys(shares, 0), []
    rates = {s: (w.numerator, w.denominator) for s, w in shares.items()}
    while True:
        while waiting and waiting[0][0] <= len(out):
            _, s = heapq.heappop(waiting)
            n, d = rates[s]
            heapq.heappush(due, (-(-(had[s] + 1) * d // n), s))
        _, s = heapq.heappop(due)
        out.append(s)
        had[s] += 1
        if had[s] == blocks[s]:
            return out
        n, d = rates[s]
        heapq.heappush(waiting, (max(len(out), had[s] * d // n), s))


def mixture(blocks: Mapping[str, int], weights: Mapping[str, float | Fraction]) -> list[str]:
    """The sources of all slots: one schedule after another, each without the sources that have ended."""
    left, out = {s: n for s, n in blocks.items() if n > 0}, []
    while left:
        part = schedule(exact({s: weights[s] for s in left}), left)
        out += part
        for s in part:
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
    return out


def block_size(sizes: Mapping[str, int], block: int, slots: int) -> int:
    """The least multiple of ``block`` by a power of two that makes at most ``slots`` blocks of whole sources, or one block each."""
    while sum(-(-n // block) for n in sizes.values()) > max(slots, len(sizes)):
        block *= 2
    return block


def plan(sizes: Mapping[str, int], weights: Mapping[str, float | Fraction], block: int) -> pa.Table:
    """``source, block, slot, first``: of every block its slot, and the position of its first document."""
    order = mixture({s: -(-n // block) for s, n in sizes.items()}, weights)
    names = sorted(set(order))
    of = np.searchsorted(names, order) if names else np.zeros(0, np.int64)
    number, held = np.zeros(len(order), np.int64), np.full(len(order), block, np.int64)
    for k, s in enumerate(names):
        at = np.flatnonzero(of == k)
        number[at] = np.arange(len(at))
        held[at[-1]] = sizes[s] - (len(at) - 1) * block  # the last block may be short
    return pa.table({"source": pa.array([names[k] for k in of], pa.string()), "block": number, "slot": np.arange(len(order)), "first": np.cumsum(held) - held})


def mix(docs: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, alpha: float = ALPHA, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """Adds ``block, slot, position`` to the rows of docs; position is gapless from 0 over the mixture.

    ``weights`` are the sources' target weights; a source without one, and every source if there are none, weighs its number
    of documents to the power ``alpha`` (as a share of all of them, times the given weights' total). A null source is a source of its
    own. Sources are expected to be few enough for the driver: it gets one number for each. Rows of a source are ordered
    by a hash of doc_id and, where docs has it, text; equal hashes go by doc_id, repeated rows stand together in any order.
    An empty table gives an empty result. Columns of docs stay; one named block, slot or position is replaced.
    """
    spark, extra = docs.sparkSession, ["block", "slot", "position"]
    names = [c for c in docs.columns if c not in extra]
    own = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(names)))  # no name of docs can clash with those below
    doc_id, source, *text = (F.col(f"__{names.index(c)}") for c in ("doc_id", "source", "text") if c in names)
    keyed = own.withColumns({"source": F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("")), "order": F.xxhash64(doc_id, *text)}).withColumn("salt", salt(spark, F.col("order")))
    groups = keyed.groupBy("source", "salt").agg(F.count("*").alias("n"))
    sizes = {r["source"]: r["n"] for r in groups.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    given = {"" if s is None else "s" + s: w for s, w in (weights or {}).items()}
    powers = {s: Fraction(n**alpha) for s, n in sizes.items()}
    scale = sum(map(fraction, given.values())) / sum(powers.values()) if given and powers else Fraction(1)
    size = block_size(sizes, block, slots)
    made = plan(sizes, {s: given.get(s, powers[s] * scale) for s in sizes}, size)
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "salt").orderBy("order", doc_id)) - 1)
    ranked = ranked.join(groups, ["source", "salt"]).withColumn("rank", F.col("base") + F.col("rank"))
    ranked = ranked.withColumns({"block": F.expr(f"rank div {size}"), "within": F.expr(f"rank % {size}")})
    placed = ranked.join(F.broadcast(spark.createDataFrame(made)), ["source", "block"])  # at most slots rows, or one a source
    at = {"block": F.col("block"), "slot": F.col("slot"), "position": F.col("first") + F.col("within")}
    return placed.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)), *(c.cast("long").alias(n) for n, c in at.items()))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
    return out.select("doc_id", "source", "block", "slot", "position")
