"""Removal of long byte strings that occur twice anywhere in a corpus, overlaps included.

1. Every window of ``window`` bytes belongs to one content-defined anchor (see anchors). Anchors are dealt by their gram's
   hash. One whose gram occurs once ends there. Anchors whose gram, place and context are all equal (copies' insides,
   most of what repeats) are settled by counting: all their windows repeat.
2. The rest share a gram but not a context: a match begins or ends nearby. Only their contexts are cut from the texts, with
   one of each repeated context of the same gram, and dealt by gram. A task feeds its contexts in batches to a
   logarithmic family of suffix arrays (see suffixes), which finds the windows that occur twice.
3. Spans meet their documents again, and the bytes that any of them covers are removed.

Grams in over ``HOT_SHARE`` of a bounded sample of documents are dealt by salt too. That only leaves more contexts to
step 2, never fewer matches. A gram with over ``GROUP`` contexts is not gathered: its windows' 128-bit hashes are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.anchors import K, anchors
from skein.llm.common import partitions, stored
from skein.llm.suffixes import Family

WINDOW, GROUP, SAMPLE, HOT_SHARE, SALTS = 200, 100_000, 2000, 0.01, 16
#: Bytes of contexts in a batch of the family: few enough that a task adds several and merges levels.
BATCH = 1 << 20


def _pack(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's first own window, how many follow it, and how far the anchor lies from it, in one long."""
    return first << 24 | (last - first) << 12 | (p - first)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = at >> 24
    return first, first + (at >> 12 & 4095), first + (at & 4095)


def _anchored(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """``h, c, rk, at, salt, hot`` of every anchor: gram, context, document, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rks, found = [], []
                for rk, t in zip(batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512), strict=True):
                    raw = t.as_py()
                    p, h, a, b = anchors(raw, window)
                    c = np.fromiter((xxhash.xxh3_64_intdigest(raw[x : y + window], z) for x, y, z in zip(a.tolist(), b.tolist(), (p - a).tolist(), strict=True)), np.uint64, len(p))
                    found.append((h.view(np.int64), c.view(np.int64), np.full(len(p), rk), _pack(p, a, b)))
                    rks.append(rk)
                h, c, rk, at = (np.concatenate(x) for x in zip(*found, strict=True))
                is_hot = np.isin(h, hot)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h, c, rk, at, np.where(is_hot, rk % SALTS, 0).astype(np.int32), is_hot))], names=["h", "c", "rk", "at", "salt", "hot"])

    return docs.select("rk", "raw").mapInArrow(run, "h long, c long, rk long, at long, salt int, hot boolean")


def hot_grams(docs: DataFrame, window: int) -> np.ndarray:
    """Grams in many of at most SAMPLE documents: at most a document's mean number of anchors / HOT_SHARE."""
    ids = docs.select("rk").distinct().orderBy(F.xxhash64("rk"), "rk").limit(SAMPLE)
    some = docs.join(F.broadcast(ids), "rk")
    seen = _anchored(some, window, np.zeros(0, np.int64)).select("h", "rk").distinct().groupBy("h").count().where(F.col("count") >= max(10, HOT_SHARE * SAMPLE))
    return seen.select("h").toArrow()["h"].to_numpy()


def _contexts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The contexts of ``wanted(rk, h, at, kind)``, with hashes of the gram and half the room on either side."""
    half = (window - K) // 2
    per_doc = wanted.groupBy("rk").agg(F.collect_list(F.struct("h", "at", "kind")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                out = []
                part = batch.slice(lo, 128)
                for rk, raw, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for r in rows:
                        a, b, p = (int(x) for x in _unpack(np.int64(r["at"])))
                        left, right = raw[max(0, p - half) : p + K], raw[p : p + K + half]
                        out.append((r["h"], rk, r["at"], r["kind"], raw[a : b + window], *(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s)).astype(np.int64)) for s in (left, right))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["h", "rk", "at", "kind", "context", "l", "r"])

    return docs.select("rk", "raw").join(per_doc, "rk").select("rk", "raw", "wanted").mapInArrow(run, "h long, rk long, at long, kind int, context binary, l long, r long")


def _shared(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether a pair (h, x) occurs twice."""
    _, at, n = np.unique(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ x.astype(np.uint64), return_inverse=True, return_counts=True)
    return n[at] > 1


def _family(window: int, batch_bytes: int):
    half = (window - K) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        h, rk, at, kind, left, right = (table[c].to_numpy() for c in ("h", "rk", "at", "kind", "l", "r"))
        first, last, p = _unpack(at)
        # a window has half the room on one side of its anchor; without a partner there it cannot repeat
        lo = np.where(_shared(h, left), first, np.maximum(first, p - half + 1))
        hi = np.where(_shared(h, right), last, np.minimum(last, p - half))
        on = np.flatnonzero(lo <= hi)
        family, contexts, size, got = Family(window), table["context"], 0, []
        lengths = np.asarray(pa.compute.binary_length(contexts))
        for batch in np.split(on, np.flatnonzero(np.diff(np.cumsum(lengths[on]) // batch_bytes)) + 1):
            family.add([contexts[int(i)].as_py() for i in batch], (lo - first)[batch], (hi - first)[batch])
        flags, counts = family.matched(), (hi - lo + 1)[on]
        ends = np.cumsum(counts)
        for i, a, b in zip(on.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            if kind[i] == 1 and (own := flags[a:b]).any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                got += [(rk[i], lo[i] + s, lo[i] + e - 1 + window) for s, e in zip(edge[::2], edge[1::2], strict=True)]
                size += 1
        yield pa.RecordBatch.from_arrays([pa.array([int(g[k]) for g in got], pa.int64()) for k in range(3)], names=["rk", "s", "e"])

    return run


def _counted(contexts: DataFrame, window: int) -> DataFrame:
    """Spans of single contexts' windows that occur twice, by counting windows' hashes: for grams of any number of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rk, at, kind, context in zip(*(batch.column(c).to_pylist() for c in ("rk", "at", "kind", "context")), strict=True):
                first, last, _ = (int(x) for x in _unpack(np.int64(at)))
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(context[i : i + window]), 1 << 64) for i in range(last - first + 1)], np.uint64)
                n = len(digests)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (digests[:, 0].view(np.int64), digests[:, 1].view(np.int64), np.full(n, rk), np.arange(first, last + 1), np.full(n, kind, np.int32)))], names=["x", "y", "rk", "s", "kind"])

    all_ = contexts.select("rk", "at", "kind", "context").mapInArrow(run, "x long, y long, rk long, s long, kind int")
    twice = all_.groupBy("x", "y").agg(F.sum(F.when(F.col("kind") == 2, 2).otherwise(1)).alias("n")).where("n > 1").select("x", "y")
    return all_.where("kind = 1").join(twice, ["x", "y"]).select("rk", "s", (F.col("s") + window).alias("e"))


def repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, batch_bytes: int = BATCH) -> DataFrame:
    """``docs(rk, raw)`` -> ``(rk, s, e)``: spans that cover exactly the bytes of windows that start anywhere else too."""
    if window < K + 2:
        raise ValueError(f"a window needs more than {K + 1} bytes")
    found = _anchored(docs, window, hot_grams(docs, window)).repartition(partitions(docs.sparkSession), "h", "salt")
    by_gram, by_context = Window.partitionBy("h", "salt"), Window.partitionBy("h", "salt", "c")
    found = found.withColumn("same", F.count("*").over(by_context)).withColumn("nth", F.row_number().over(by_context.orderBy("rk", "at")))
    found = found.withColumn("all", F.count("*").over(by_gram)).withColumn("least", F.min("same").over(by_gram))
    # 0: its windows repeat; 1: to be compared; 2: as 0, and what others are compared with
    kind = F.when(F.col("same") == 1, 1).when((F.col("nth") == 1) & (F.col("hot") | (F.col("least") == 1)), 2).otherwise(0)
    found = found.where("all > 1 or hot").select("rk", "at", kind.cast("int").alias("kind"), F.when(kind > 0, F.col("h")).alias("h"))
    found = stored(found, "suffix-anchors")
    contexts = _contexts(docs, found.where("kind > 0"), window)
    large = found.where("kind > 0").groupBy("h").count().where(F.col("count") > group).select("h")
    spans = found.where("kind != 1").select("rk", F.expr("shiftright(at, 24)").alias("s"), F.expr(f"shiftright(at, 24) + (shiftright(at, 12) & 4095) + {window}").alias("e"))
    if large.isEmpty():
        return spans.unionAll(contexts.repartition(partitions(docs.sparkSession), "h").mapInArrow(_family(window, batch_bytes), "rk long, s long, e long"))
    contexts = stored(contexts, "suffix-contexts")
    few = contexts.join(large, "h", "left_anti").repartition(partitions(docs.sparkSession), "h")
    return spans.unionAll(few.mapInArrow(_family(window, batch_bytes), "rk long, s long, e long")).unionAll(_counted(contexts.join(large, "h", "left_semi"), window))


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def deduplicate(docs: DataFrame, window: int = WINDOW, group: int = GROUP, batch_bytes: int = BATCH) -> DataFrame:
    """``doc_id, n_bytes, removed array<struct<s, e>>, kept`` (binary) for each row of docs.

    Removed is each byte of the text's UTF-8 that is covered by a string of ``window`` bytes which also starts anywhere
    else in docs, the same text included; strings are judged on the input. A null text counts as empty. Repeated rows
    repeat each other, so of texts of at least a window nothing stays. An empty table gives an empty result. Other columns
    of docs are not read. Documents are told apart by a 64-bit hash of id and text.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    texts = texts.withColumn("rk", F.xxhash64("doc_id", "raw"))
    spans = repeats(texts.select("rk", "raw"), window, group, batch_bytes).groupBy("rk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # a set: repeated rows find the same spans
    runs = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    schema = texts.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)").alias("removed"), F.lit(b"").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, removed, kept = [], [], []
                for t, own in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = t.as_py()
                    gone = cover([(x["s"], x["e"]) for x in own or []])
                    sizes.append(len(raw))
                    removed.append([{"s": s, "e": e} for s, e in gone])
                    kept.append(b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, runs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return texts.join(spans, "rk", "left").select("doc_id", "raw", "spans").mapInArrow(run, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
