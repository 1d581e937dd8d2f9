"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint's bits are weighted votes of its shingles' hashes. For radius r, every bit position gets a non-zero vector
of r + 1 bits, and each of the 2^(r+1) - 1 non-zero vectors v is a table whose mask has the positions with an odd inner
product with v. The vectors of at most r differing positions span a space of at most r dimensions, so some v is
orthogonal to all of them: in that table the two masked fingerprints are equal. No pair within the radius is missed.

Only distinct fingerprints are searched. Tables' buckets are counted first: single ones end there, two fingerprints are
compared in place, buckets up to ``BUCKET`` are linked in a task by a spanning forest. Fingerprints of larger buckets
are linked by midpoints: each emits every point at distance 0 to r / 2; two that share a point are within r, two within r
share one. So a bucket of any size costs a fixed number of rows for each of its fingerprints.

``similar_documents`` takes these links as candidates, adds those of MinHash keys of the texts' sets of shingles, which reach
pairs that differ in more bits, and decides each by exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import fewer, of_worker, stored
from skein.llm.components import connected_components, joined_stars, labelled, stars as star_edges

BITS = 64
#: Fingerprints of a bucket that one task compares with each other.
BUCKET = 8192
#: MinHash tables, and the least hashes in a key of one.
TABLES, ROWS = 24, 5
#: Rounds in which a bucket's nodes are checked against one of them before the rest is joined by rare shingles.
STARS = 2
#: Pairs that one copy of their common text is sent with, about.
STAR = 256


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(radius: int) -> list[int]:
    """The covering masks of 64 bits, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    of = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (of[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: bit b is set if over half of the shingles' XXH64 have it."""
    return vote((text or b"").lower().split(), words, seed)  # bytes: A-Z only, and the six ASCII spaces


def vote(w: list[bytes], words: int, seed: int) -> int:
    if not w:
        return 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return h64(join(w), seed)
    n = len(w) - words + 1
    h = np.fromiter((h64(s, seed) for s in map(join, zip(*(w[i:] for i in range(words)), strict=False))), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        part = h[i : i + 8192]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], words: int = 4, seed: int = 42) -> DataFrame:
    """``keep`` columns of docs and ``fp``, the fingerprint of ``text`` as a signed long."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Least member of each one's component in a bucket. Blocks of rows bound the memory."""
    n = len(fps)
    label, step = np.arange(n), 256

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for lo in range(0, n, step):
        for k, row in enumerate(np.bitwise_count(fps[lo : lo + step, None] ^ fps[None, lo:]) <= radius):
            js = np.flatnonzero(row[k + 1 :]) + lo + k + 1
            for j in js[np.unique(label[js], return_index=True)[1]] if len(js) > 1 else js:  # one of each present label
                a, b = root(lo + k), root(int(j))
                if a != b:
                    label[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


def _linked(radius: int):
    """Buckets ``(fps)`` to a spanning forest of the links in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for (fps,) in zip(*batch.columns, strict=True):
                fps = np.sort(fps.values.to_numpy(zero_copy_only=False))
                label = _forest(fps, radius)
                moved = label != np.arange(len(fps))
                u.append(fps[moved])
                v.append(fps[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])

    return run


def _midpoints(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes(id, fp)`` at every point within half the radius of their fingerprint: ``(id, point)``."""
    half = radius // 2
    flips = [signed(sum(1 << i for i in c)) for k in range(half + 1) for c in combinations(range(BITS), k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(flips, np.int64)
        for batch in batches:
            ids, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for lo in range(0, len(ids), 32):
                points = (fps[lo : lo + 32, None] ^ own[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 32], len(own))), pa.array(points)], names=["id", "point"])

    return nodes.select("id", "fp").mapInArrow(run, "id long, point long")


def bucket_keys(fp: Column, radius: int) -> Column:
    """``array<struct<t, key>>``: the fingerprint under every mask."""
    return F.array(*(F.struct(F.lit(t).cast("short").alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(radius))))


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``fps(fp)``, distinct -> ``(u, v)``: edges within the radius, an even one, that have the components of all such edges."""
    if radius % 2:
        raise ValueError("the radius must be even")
    dealt = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("b")).select("fp", "b.t", "b.key")
    counts = dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    counts = stored(counts, "simhash-buckets")
    two = counts.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    some = dealt.join(counts.where(f"n > 2 and n <= {bucket}").select("t", "key"), ["t", "key"])
    few = some.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    few = few.mapInArrow(_linked(radius), "u long, v long")
    hot = dealt.join(counts.where(f"n > {bucket}").select("t", "key"), ["t", "key"]).select("fp").distinct()
    points = _midpoints(hot.select(F.col("fp").alias("id"), "fp"), radius)
    least = points.groupBy("point").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    stars = points.join(least, "point").where("id != v").select(F.col("id").alias("u"), "v")
    return two.unionAll(few).unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of docs: ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id
    reachable. Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows give
    repeated results. A null doc_id keeps its row and never names a component that has another id; an empty table gives
    an empty result. Other columns of docs are not read.
    """
    fp = stored(fingerprints(docs, ["doc_id"], words, seed), "simhash-fingerprints")
    reps = fp.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    cc = connected_components(links(reps.select("fp"), radius, bucket))
    of = reps.join(cc.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "label").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles. A shorter text is one shingle, one without a word has none."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h64(join(w))], np.uint64)
    n = len(w) - words + 1
    return np.unique(np.fromiter(map(h64, map(join, zip(*(w[i:] for i in range(words)), strict=False))), np.uint64, n))


class MinHash:
    """Keys of a set in ``tables`` tables, each of ``rows`` least hashes: sets of Jaccard similarity s share one with s ** rows."""

    def __init__(self, tables: int = TABLES, rows: int = ROWS, seed: int = 42) -> None:
        flip, odd, mix = np.random.default_rng(seed).integers(0, 2**64, (3, tables * rows), np.uint64)
        self.shape, self.flip, self.odd, self.mix = (tables, rows), flip, odd | np.uint64(1), mix | np.uint64(1)

    def keys(self, h: np.ndarray) -> np.ndarray:
        least = np.full(len(self.odd), 2**64 - 1, np.uint64)
        for i in range(0, len(h), 256):
            np.minimum(least, ((h[i : i + 256, None] ^ self.flip) * self.odd).min(0), out=least)
        return (least * self.mix).reshape(self.shape).sum(1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, bound: Fraction) -> bool:
    """Whether the Jaccard similarity of sorted sets is at least bound, in whole numbers. Two empty sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * bound.denominator >= (len(a) + len(b) - common) * bound.numerator


def _checked(pairs: DataFrame, texts: DataFrame, words: int, bound: Fraction) -> DataFrame:
    """``pairs(u, v)`` and ``ok``, whether the sets of shingles of their whole texts are alike.

    Texts are shuffled once: a pair brings that of u, and that of v goes ahead of every ``STAR`` or so pairs that v is in, so
    a text that many are checked against is neither sent with each of them nor met by all in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            u, v, ok = [], [], []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if a == b:
                    hub, own = b, shingles(text.as_py(), words)
                elif b == hub:
                    u.append(a)
                    v.append(b)
                    ok.append(alike(shingles(text.as_py(), words), own, bound))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    pairs = stored(pairs.select("u", "v"), "minhash-pairs", narrow=True)
    parts = pairs.groupBy("v").agg((F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(parts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts") + 1).alias("part"))
    rows = dealt.unionAll(dealt.select(F.col("v").alias("u"), "v", "part").distinct())
    met = rows.join(texts.select(F.col("id").alias("u"), "text"), "u").repartition("v", "part").sortWithinPartitions("v", "part", F.col("u") != F.col("v"))
    return stored(fewer(met.select("u", "v", "text")).mapInArrow(run, "u long, v long, ok boolean"), "minhash-checked")


def _sharing(live: DataFrame, texts: DataFrame, words: int, bound: Fraction) -> DataFrame:
    """Pairs of ``live(id, size, label)`` under different labels that may be alike: ``(u, v)``. No pair that is alike is missed.

    Shingles are put in one order, the rarest among the live texts first. Of two sets alike to ``bound`` each holds a
    common shingle among its first size - ceil(bound * size) + 1, so only these are joined; and their first common one has
    enough shared shingles behind it on either side. Texts that merely have a passage or a template in common fail either
    test. Shingles of one text alone meet nothing and are left out before the sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingles(t.as_py(), words) for t in part.column(1).cast(pa.binary())]
                ids = np.repeat(part.column(0).to_numpy(), [len(h) for h in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "token"])

    tokens = stored(texts.join(live.select("id"), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, token long"), "minhash-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by = Window.partitionBy("id")
    shared = tokens.join(often, "token").withColumns({"nth": F.row_number().over(by.orderBy("n", "token")), "k": F.count("*").over(by)})
    need = F.expr(f"(size * {bound.numerator} + {bound.denominator - 1}) div {bound.denominator}")
    first = shared.join(live, "id").withColumn("left", F.col("k") - F.col("nth") + 1).where(F.col("left") >= need)
    first = stored(fewer(first.select("token", "id", "size", "label", "left")), "minhash-prefixes")
    mixed = first.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("token")
    first = first.join(mixed, "token", "left_semi")
    other = first.select("token", *(F.col(c).alias(f"other_{c}") for c in ("id", "size", "label", "left")))
    # alike means: (common) / (size + size - common) >= bound
    enough = F.least("left", "other_left") * F.lit(bound.denominator + bound.numerator) >= (F.col("size") + F.col("other_size")) * F.lit(bound.numerator)
    met = first.join(other, "token").where("id > other_id and label != other_label").where(enough)
    return met.select(F.col("id").alias("u"), F.col("other_id").alias("v")).distinct()


def _near(prints: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """``prints(fp, id)`` -> pairs ``(u, v, size, other_size)`` that join all nodes whose fingerprints are linked within the radius."""
    heads = stored(prints.groupBy("fp").agg(F.min("id").alias("head")), "simhash-heads", narrow=True)
    same = prints.join(heads, "fp").select(F.col("id").alias("u"), F.col("head").alias("v"))
    end = lambda c, head: heads.select(F.col("fp").alias(c), F.col("head").alias(head))
    other = links(heads.select("fp"), radius).join(end("u", "__u"), "u").join(end("v", "__v"), "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    size = lambda c, name: nodes.select(F.col("id").alias(c), F.col("size").alias(name))
    return same.unionAll(other).where("u != v").distinct().join(size("u", "size"), "u").join(size("v", "other_size"), "v")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = TABLES, rows: int = ROWS, stars: int = STARS, radius: int = 4) -> DataFrame:
    """One row for each row of docs: ``doc_id, text_hash, component_id, kept``, by Jaccard similarity of ``words``-word shingles.

    Candidates have fingerprints that operator 1 links (its words, seed and ``radius``, all nodes of a linked group joined to
    each other), or share a MinHash key of their sets of shingles in any table. By the keys alone a pair at the similarity s
    is missed with (1 - s ** rows) ** tables, whatever its length and however its edits lie: 1 in 14,000 at 0.8, fewer above. Every
    candidate is decided by the exact similarity of the sets of its whole texts; shingles are compared by 64-bit hashes.

    Texts with one set are one node. In each bucket all nodes are first checked against the one that meets most others,
    ``stars`` times, so copies of one text come together at a row each. Members of buckets that still hold several
    components are then joined by their rarest shingles (see _sharing), which loses no pair and makes none of texts that
    have only a common passage.
    component_id is the smallest doc_id reachable; kept marks the component's first row by doc_id and text_hash, and its
    repeats. Nulls, repeats and other columns are as for near_duplicates.
    """
    bound, own = Fraction(str(similarity)), MinHash(tables, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_worker()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):  # all rows; sets of so many at a time
                part = batch.slice(lo, 1024)
                given = [t.as_py() for t in part.column(2).cast(pa.binary())]
                sets = [shingles(t, words) for t in given]
                fps = np.fromiter(map(fingerprint, given), np.uint64, len(given))
                made = [pa.array(fps.view(np.int64)), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array([own.keys(h) for h in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], names=["doc_id", "text_hash", "fp", "digest", "size", "keys"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = texts.select("doc_id", "text_hash", F.lit(0).cast("long").alias("fp"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("size"), F.array(F.lit(0).cast("long")).alias("keys")).schema
    seen = stored(texts.mapInArrow(run, schema), "minhash-sets")
    row = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")  # a row with an id goes before one without
    nodes = seen.groupBy("digest", "size", "keys").agg(F.min("doc_id").alias("rep"), F.min(row).alias("first"))
    nodes = stored(fewer(nodes).withColumn("id", F.monotonically_increasing_id()), "minhash-nodes")
    dealt = nodes.select("id", "size", F.explode("keys").alias("h"))
    counts = dealt.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    met = stored(fewer(dealt.join(counts, "h")), "minhash-buckets")
    degrees = met.join(met.groupBy("h").agg(F.count("*").alias("n")), "h").groupBy("id").agg(F.sum("n").alias("degree"))
    met = stored(fewer(met.join(degrees, "id")), "minhash-degrees")
    fits = F.least("size", "other_size") * F.lit(bound.denominator) >= F.greatest("size", "other_size") * F.lit(bound.numerator)
    prints = stored(seen.select("fp", "digest").distinct().join(nodes.select("digest", "id"), "digest").select("fp", "id"), "simhash-prints", narrow=True)
    near = stored(_near(prints, nodes, radius).where(fits).select("u", "v"), "simhash-pairs", narrow=True)
    asked = nodes.join(met.select("id").unionAll(near.select("u")).unionAll(near.select("v")).distinct(), "id", "left_semi").select("id", F.col("first.text_hash").alias("text_hash"))
    asked = stored(fewer(texts.select("text_hash", "text").join(asked, "text_hash").dropDuplicates(["text_hash", "id"]).select("id", "text")), "minhash-texts")
    together = lambda cc: met if cc is None else met.join(cc.withColumnRenamed("node", "id"), "id", "left")
    tested, linked, cc = None, None, None
    for k in range(stars + 1):
        now = together(cc).select("h", "id", "size", "degree", (F.lit(None).cast("long") if cc is None else F.col("component")).alias("component"))
        now = now.withColumn("label", F.coalesce("component", "id"))
        live = now.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max(F.struct(F.isnull("component").alias("alone"), "degree", "id", "size", "label")).alias("hub")).where("a != b")
        if k < stars:
            pairs = now.join(live.select("h", F.col("hub.id").alias("other"), F.col("hub.size").alias("other_size"), F.col("hub.label").alias("other_label")), "h")
            pairs = pairs.where("label != other_label").where(fits).select(F.col("id").alias("u"), F.col("other").alias("v"))
            pairs = (pairs.unionAll(near) if tested is None else pairs).distinct()
        else:
            pairs = _sharing(stored(now.join(live.select("h"), "h", "left_semi").select("id", "size", "label").distinct(), "minhash-live", narrow=True), asked, words, bound)
        if tested is not None:
            for a, b in (("u", "v"), ("v", "u")):
                pairs = pairs.join(tested.select(F.col(a).alias("u"), F.col(b).alias("v")), ["u", "v"], "left_anti")
        checked = _checked(pairs, asked, words, bound)
        tested = checked if tested is None else tested.unionAll(checked)
        found = checked.where("ok").select("u", "v")
        linked = star_edges(found) if linked is None else joined_stars(linked, found)
        cc = labelled(linked)
    of = nodes.join(cc.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    least = of.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("first").alias("kept_row"))
    met = seen.select("doc_id", "text_hash", "digest").join(of.join(least, "label").select("digest", "component_id", "kept_row"), "digest")
    return met.select("doc_id", "text_hash", "component_id", (row == F.col("kept_row")).alias("kept"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
