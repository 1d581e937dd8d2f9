"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

A text's tokens are its words' shapes (letters and digits by class, runs collapsed, marks kept) with a flag for a word
that repeats the one before. Features are the shapes' 1-, 2- and 3-grams and the lower-cased words, hashed to a fixed
table, each at most once a document. With p and q the smoothed shares of good and bad documents that have a feature, an
indicator weighs log(p / q); the model is fitted to these by dual coordinate descent, and a logistic curve, fitted on
rows that the descent did not see, turns margins into scores.

Fitting uses at most ``rows`` labelled documents, those with the least hash of their id, whatever the corpus holds; only
their feature numbers reach the driver. Scoring runs where documents are read, over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import of_worker, with_text

BITS, ROWS, C, PASSES, KEEP = 17, 8000, 1.0, 12, 0.3
SIZE = 1 << BITS

#: Bytes to classes: a lower, A upper, 0 digit, e any byte of a longer character; marks and white space stay.
SHAPE = bytes(97 if 97 <= b < 123 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 101 if b > 127 else b for b in range(256))
RUNS = re.compile(rb"([aA0e])\1+|([^aA0e\s])\2\2+")


def features(text: bytes) -> np.ndarray:
    """Sorted, distinct feature numbers of one whole text; an empty text has the one of no words."""
    words = text.lower().split()
    shapes = RUNS.sub(lambda m: m[0][:2], text.translate(SHAPE)).split()
    same = [b"="] * len(words)
    for i in range(1, len(words)):
        if words[i] != words[i - 1]:
            same[i] = b""
    same[:1] = [b""] if same else []
    tokens = [b"^", *map(bytes.__add__, shapes, same), b"$"]
    grams = set(tokens) | set(zip(tokens, tokens[1:], strict=False)) | set(zip(tokens, tokens[1:], tokens[2:], strict=False))
    joined = {g if isinstance(g, bytes) else b" ".join(g) for g in grams}
    numbers = {zlib.crc32(g) & (SIZE - 1) for g in joined}
    numbers |= {zlib.crc32(w, 1) & (SIZE - 1) for w in set(words)}
    return np.array(sorted(numbers), np.int32)


class Model(NamedTuple):
    #: Weight of each feature with its log-count ratio multiplied in.
    weights: np.ndarray
    bias: float
    #: The score is the logistic function of slope * margin + shift.
    slope: float
    shift: float

    def score(self, rows: np.ndarray) -> float:
        margin = (self.weights[rows].sum() / np.sqrt(max(1, len(rows)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float, passes: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is a feature of value 1."""
    w, bias, alpha, order = np.zeros(SIZE), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    cost = np.where(y > 0, c, c * max(1.0, (y > 0).sum() / max(1, (y < 0).sum())) ** 0.5)
    square = np.array([v @ v + 1 for v in values])
    for _ in range(passes):
        for i in order.permutation(len(y)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(label 1) by Newton's method, with smoothed targets and a small ridge."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.column_stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(beta[0])), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = C, passes: int = PASSES) -> Model:
    """From feature numbers and 0/1 labels. Without both labels the score is the smoothed share of label 1."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if (y > 0).all() or (y < 0).all():
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    count = {s: np.ones(SIZE) for s in (1.0, -1.0)}
    for r, s, h in zip(rows, y, held, strict=True):
        if not h:
            count[s][r] += 1
    n = {s: 2 + ((y == s) & ~held).sum() for s in count}
    ratio = np.log(count[1.0] / n[1.0]) - np.log(count[-1.0] / n[-1.0])
    values = np.split(np.empty(sum(map(len, rows))), np.cumsum([len(r) for r in rows])[:-1])  # one block, that the system gets back
    for r, v in zip(rows, values, strict=True):
        np.divide(ratio[r], np.sqrt(max(1, len(r))), out=v)
    on = np.flatnonzero(~held)
    w, bias = descend([rows[i] for i in on], [values[i] for i in on], y[on], c, passes)
    margin = np.array([w[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    return Model(w * ratio, bias, *logistic(margin[held] if held.any() else margin, y[held] if held.any() else y))


def remainder(id_: Column, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % by).cast("int")


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fits on the ``rows`` labelled documents with the least hash of their id. Ids with two different labels, null ids
    and labels other than 0 and 1 are left out, equal hashes go by id, and of rows with one id the one with the least text
    is learned; without any labelled row every score is 0.5."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__most")).where("quality = __most")
    # ids first: the sample is bounded before any text is read; an id without a document costs its place
    sample = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a repeated id brings one row, not all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("quality"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "quality", "features"])

    got = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id string, quality int, features array<int>").toArrow()
    ids, quality = got["doc_id"].to_pylist(), got["quality"].to_numpy()
    order = np.array(sorted(range(len(ids)), key=lambda i: (zlib.crc32(ids[i].encode()), ids[i], i)), np.int64)
    found = got["features"].combine_chunks().take(pa.array(order))
    rows = np.split(found.flatten().to_numpy().astype(np.int64), found.offsets.to_numpy()[1:-1]) if len(ids) else []
    del got, found
    pa.default_memory_pool().release_unused()  # the driver keeps running, often through more stages
    return fit(rows, quality[order])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``, 0 to 1, of every whole text.

    A null text scores as an empty one. Repeated rows score alike; an empty table gives an empty result. A kept column of
    the name score is replaced.
    """
    keep = [c for c in keep if c.lower() != "score"]
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema
    sent, at = with_text(docs, keep)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_worker()
        own = shipped.value
        for batch in batches:
            scores = [own.score(features(t.as_py() or b"")) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return sent.mapInArrow(run, schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
