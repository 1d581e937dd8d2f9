"""Packing documents into windows of a fixed number of tokens, by non-negative least squares over a length histogram.

A document of n tokens is cut into whole windows, a body of the longest multiple of ``quantum`` tokens that is left, and
a tail shorter than that. Bodies have window / quantum - 1 lengths. All multisets of at most ``depth`` lengths that fill a
window exactly are the columns of a matrix; non-negative least squares finds repeat counts whose lengths' totals come
closest to the histogram. Counts are rounded down and cut to what there is. Bodies left over and all tails then fill
further windows one after another, being cut where a window ends, so only the last window is padded.

Only the histogram, of a size fixed by the window, reaches the driver. A row's place follows from its rank among bodies
of its length and from running sums; both are taken in salted groups plus the groups' totals, so no length, however
common, is ranked in one task. Where docs have an order, consecutive ranges of ``span`` documents are packed each by
itself, to the whole histogram's counts in proportion, and sequences are numbered by range; only leftovers run on into
the next range. Ranges then give the driver one histogram each. Token ids are made once and stored; they are shuffled once, to meet their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import salt, stored
from skein.llm.tokens import TEXT, runs, word_ids

WINDOW, QUANTUM, DEPTH, END = 2048, 32, 4, 1
#: Documents of a range that is packed by itself where an order is given: one period of the mixture.
SPAN = 16384


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 2 to depth positive numbers with the sum units."""
    found: list[tuple[int, ...]] = []

    def more(left: int, most: int, got: tuple[int, ...]) -> None:
        if not left:
            found.append(got)
        elif len(got) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(got)) < left:
                    break
                more(left - k, k, (*got, k))

    more(units, units - 1, ())
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with x >= 0, by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        if passive.all() or w.max() <= tol:
            break
        passive[int(w.argmax())] = True
        while True:
            on = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if z.min() > 0:
                break
            bad = z <= 0
            step = min(1.0, float((x[on][bad] / np.maximum(x[on][bad] - z[bad], 1e-300)).min()))
            x[on] += step * (z - x[on])
            off = on[bad & (x[on] <= 1e-12)] if (bad & (x[on] <= 1e-12)).any() else on[bad][[int(x[on][bad].argmin())]]
            passive[off] = False
            x[off] = 0
            if not passive.any():
                break
        x[:] = 0
        if passive.any():
            x[on] = np.maximum(z, 0)
    return x


def plan(hist: np.ndarray, depth: int = DEPTH) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """``hist[k]``: bodies of k + 1 quanta. The combinations used and how often each is repeated."""
    combos = combinations(len(hist) + 1, depth)
    a = np.zeros((len(hist), len(combos)))
    for j, c in enumerate(combos):
        np.add.at(a[:, j], np.array(c) - 1, 1)
    scale = max(1.0, float(hist.max(initial=0)))
    x = fitted(a, np.floor(nnls(a, hist / scale) * scale + 1e-6).astype(np.int64), hist)
    on = np.flatnonzero(x > 0)
    return [combos[j] for j in on], x[on]


def fitted(a: np.ndarray, x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Repeat counts x, cut where they use more than the histogram."""
    for k in range(len(hist)):  # least squares may ask for more bodies of a length than there are
        over = int(a[k] @ x - hist[k])
        for j in np.flatnonzero((a[k] > 0) & (x > 0)):
            if over <= 0:
                break
            less = min(int(x[j]), -(-over // int(a[k, j])))
            x[j] -= less
            over -= less * int(a[k, j])
    return x


def plans(hists: np.ndarray, depth: int = DEPTH) -> tuple[list[tuple[int, ...]], list[np.ndarray]]:
    """``hists[g, k]``: bodies of k + 1 quanta of range g. The combinations, and their repeats in each range."""
    total = hists.sum(0)
    combos, x = plan(total, depth)
    if len(hists) == 1:
        return combos, [x]
    a = np.zeros((len(total), len(combos)))
    for j, c in enumerate(combos):
        np.add.at(a[:, j], np.array(c) - 1, 1)
    return combos, [fitted(a, np.floor(x * (h.sum() / max(1, total.sum()))).astype(np.int64), h) for h in hists]


class Places:
    """Where the r-th body of each length goes: window, and offset in it."""

    def __init__(self, units: int, quantum: int, combos: list[tuple[int, ...]], repeats: np.ndarray) -> None:
        self.windows, self.used = int(repeats.sum()), [0] * units
        base, rows = 0, [[] for _ in range(units)]
        for c, x in zip(combos, repeats.tolist(), strict=True):
            for k in sorted(set(c)):
                m, at = c.count(k), sum(q for q in c if q < k) * quantum
                rows[k].append((self.used[k], base, m, at))
                self.used[k] += x * m
            base += x
        self.rows = [np.array(r, np.int64).reshape(-1, 4) for r in rows]
        self.quantum = quantum

    def of(self, k: int, rank: int) -> tuple[int, int]:
        first, base, m, at = self.rows[k][np.searchsorted(self.rows[k][:, 0], rank, "right") - 1].tolist()
        return base + (rank - first) // m, at + (rank - first) % m * k * self.quantum


def tokenized(docs: DataFrame, tokenizer: str, end: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian, 2 or 4 bytes each, with the end id) and ``n``; null text counts as empty."""
    schema = docs.select(*keep, F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        last, width = np.array([end], words.dtype).tobytes(), words.dtype.itemsize
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.string())
            for lo, hi in runs(texts, TEXT):
                part = batch.slice(lo, hi - lo)
                ids, n = words.many(texts.slice(lo, hi - lo), last)
                ends = pa.array(np.append(0, n.cumsum() * width)).cast(pa.int32())
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column, pa.array(n, pa.int64())], names=[*keep, "ids", "n"])

    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")).mapInArrow(run, schema)


def _before(df: DataFrame, of: str, by: list[str], name: str) -> DataFrame:
    """Adds the sum of ``of`` over the rows that come before, within ``by``, in the order of salt and row_id."""
    inner = F.sum(of).over(Window.partitionBy(*by, "salt").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1))
    order = Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, "salt").agg(F.sum(of).alias("__sum"))
    sums = sums.select(*by, "salt", F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__base"))
    return df.join(sums, [*by, "salt"]).withColumn(name, F.coalesce(inner, F.lit(0)) + F.col("__base")).drop("__base")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH, end: int = END, order: str | None = None, span: int = SPAN) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    Every document's ids, then the end id, lie in exactly one piece each; pieces of a sequence are gapless from offset 0.
    All sequences but at most one are full. A null or empty text is the end id alone. Repeated rows, also of one doc_id,
    are packed each. An empty table gives no piece. Other columns of docs are not read.
    ``order`` names a column that numbers the rows, without gaps or repeats from 0: sequences then follow it range by range.
    """
    if window % quantum:
        raise ValueError("quantum must divide window")
    spark, units = docs.sparkSession, window // quantum
    if order:
        ids = tokenized(docs.withColumn("row_id", F.col(order).cast("long")), tokenizer, end, ["doc_id", "row_id"])
    else:
        ids = tokenized(docs, tokenizer, end, ["doc_id"]).withColumn("row_id", F.monotonically_increasing_id())
    ids = stored(ids, "packing-ids")
    of = F.expr(f"cast(row_id div {span} as int)") if order else F.lit(0)
    meta = ids.select("row_id", "n", of.alias("span")).withColumns({"full": F.expr(f"n div {window}"), "rest": F.expr(f"n % {window}")})
    meta = meta.withColumns({"k": F.expr(f"cast(rest div {quantum} as int)"), "one": F.lit(1).cast("long"), "salt": F.col("span") if order else salt(spark, F.col("row_id"))})
    counted = meta.groupBy("span", "k").count().collect()  # at most units rows a range
    hists = np.zeros((max([r["span"] for r in counted], default=0) + 1, units - 1), np.int64)
    for g, k, n in counted:
        if k:
            hists[g, k - 1] = n
    combos, repeats = plans(hists, depth)
    places = [Places(units, quantum, combos, x) for x in repeats]
    used = spark.createDataFrame([(g, k, u) for g, p in enumerate(places) for k, u in enumerate(p.used) if u], "span int, k int, used long")
    meta = stored(_before(_before(meta, "one", ["span", "k"], "rank"), "full", [], "full_before"), "packing-ranks")
    meta = meta.join(F.broadcast(used), ["span", "k"], "left").withColumn("placed", F.col("rank") < F.coalesce("used", F.lit(0))).withColumn("loose", F.when(F.col("placed"), F.expr(f"rest % {quantum}")).otherwise(F.col("rest")))
    sums = np.zeros((len(places), 2), np.int64)
    for g, some, full in meta.groupBy("span").agg(F.sum("loose"), F.sum("full")).collect():
        sums[g] = some, full
    before = np.concatenate([[[0, 0]], sums.cumsum(0)])
    first_loose = -(-before[:, 0] // window)  # a window of leftovers is the range's in which it begins
    made = np.array([p.windows for p in places]) + np.diff(first_loose) + sums[:, 1]
    first = made.cumsum() - made
    shipped = spark.sparkContext.broadcast((places, first, first_loose, before[:, 1]))
    meta = _before(meta, "loose", [], "loose_before").select("row_id", "span", "full", "k", "rank", "placed", "loose", "full_before", "loose_before")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = ids.select("doc_id", *(F.lit(0).cast("long").alias(c) if c != "ids" else F.lit(b"").alias(c) for c in names[1:])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_ids(tokenizer).dtype
        places, first, first_loose, first_full = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols = {c: part.column(c).to_pylist() for c in part.schema.names if c not in ("doc_id", "ids")}
                at: list[int] = []
                out: list[tuple] = []
                for i, raw in enumerate(part.column("ids")):
                    own = np.frombuffer(raw.as_buffer(), dtype).astype("<u4")
                    n, full = len(own), cols["full"][i]
                    g = cols["span"][i]
                    own_full = int(first[g] + places[g].windows + first_loose[g + 1] - first_loose[g] - first_full[g]) + cols["full_before"][i]
                    cuts = [(w * window, window, own_full + w, 0) for w in range(full)]
                    start = full * window
                    if cols["placed"][i] and cols["k"][i]:
                        k = cols["k"][i]
                        at_window, at_offset = places[g].of(k, cols["rank"][i])
                        cuts.append((start, k * quantum, int(first[g]) + at_window, at_offset))
                        start += k * quantum
                    left, to = cols["loose"][i], cols["loose_before"][i]
                    while left:
                        some = min(left, window - to % window)
                        h = int(np.searchsorted(first_loose[:-1], to // window, "right")) - 1
                        cuts.append((start, some, int(first[h] + places[h].windows - first_loose[h]) + to // window, to % window))
                        start, to, left = start + some, to + some, left - some
                    at += [i] * len(cuts)
                    out += [(s, m, own[s : s + m].tobytes(), n, q, o) for s, m, q, o in cuts]
                arrays = [part.column("doc_id").take(pa.array(at, pa.int64()))]
                for j, c in enumerate(names[1:]):
                    arrays.append(pa.array([r[j] for r in out], pa.binary() if c == "ids" else pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ids.select("row_id", "doc_id", "ids").join(meta, "row_id").mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
