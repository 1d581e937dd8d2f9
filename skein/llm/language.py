"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes one blank; its 1- to 4-grams of characters are hashed to a
table of embeddings, whose average over the whole text a linear layer turns into languages. Embeddings and layer are
trained together by stochastic gradient descent. A temperature, fitted on rows kept from the descent, calibrates the
scores, and the least score at which ``precision`` of these rows were right is the model's own bound for rejection.

Training takes at most ``each`` documents of a language and about ``rows`` in all, those with the least hash of their id;
their n-gram counts are what the driver gets. Prediction runs where documents are read, over whole texts, without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.quality import remainder

BUCKETS, DIM, EACH, ROWS, EPOCHS, RATE, BATCH, SLICE = 4096, 16, 500, 8000, 30, 0.5, 32, 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """N-gram counts over the buckets, of the whole text; None if it has no letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    total, before = np.zeros(BUCKETS, np.int64), np.array([32], np.uint32)
    for lo in range(0, len(text), SLICE):
        part = np.frombuffer(text[lo : lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        part = np.append(np.where(letters()[part], part, np.uint32(32)), np.array([32] * (lo + SLICE >= len(text)), np.uint32))
        blank = part == 32
        part = part[~(blank & np.append(before[-1] == 32, blank[:-1]))]
        old = len(before) * (lo > 0)
        part = np.concatenate([before, part])
        h, n = np.zeros(len(part), np.uint32), len(part)
        for size in range(1, min(4, n) + 1):
            h = (h[: n - size + 1] * np.uint32(0x01000193)) ^ (part[size - 1 :] * np.uint32(0x9E3779B1))
            counted = max(0, old - size + 1)  # with the slice before
            total += np.bincount((h[counted:] * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=BUCKETS)
        before = part[-3:]
    return total


class Model(NamedTuple):
    languages: list[str]
    #: Embeddings times layer: averaged counts go to logits at once.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Scores below are rejected.
    bound: float

    def predict(self, total: np.ndarray) -> tuple[str, float]:
        z = (total @ self.logits / max(1, total.sum()) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, langs: list[str], precision: float = 0.99, seed: int = 0) -> Model:
    """From rows of counts and their languages."""
    names = sorted(set(langs))
    y, rng = np.array([names.index(v) for v in langs]), np.random.default_rng(seed)
    x = x / np.maximum(1, x.sum(1, keepdims=True))
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    held = np.arange(len(y)) % 5 == 4
    if not held.any():
        held[:] = True
    on = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    scale = np.sqrt(BUCKETS) / 4  # averages over many buckets are small
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in np.array_split(rng.permutation(on), max(1, len(on) // BATCH)):
            own = x[i] * scale
            hidden = own @ e
            d = _softmax(hidden @ w + b)
            d[np.arange(len(i)), y[i]] -= 1
            d /= len(i)
            back = d @ w.T
            w -= rate * hidden.T @ d
            b -= rate * d.sum(0)
            e -= rate * scale * own.T @ back
    logits = e @ w * scale
    z, t = x[held] @ logits + b, y[held]
    loss = lambda temperature: -np.log(np.maximum(1e-12, _softmax(z / temperature)[np.arange(len(t)), t])).mean()
    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    p = _softmax(z / temperature)
    top, right = p.max(1), p.argmax(1) == t
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    return Model(names, logits, b, float(temperature), float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0)


def train(docs: DataFrame, each: int = EACH, rows: int = ROWS) -> Model | None:
    """Fits on ``each`` documents of every non-null ``lang``, fewer where languages would have over ``rows`` together.

    These are the ones with the least hash of their id. Of rows with one id and language the one with the least text is
    learned; an id with several languages is learned under each, from its own rows. None if no document has both a
    language and a letter.
    """
    named = docs.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # a number a language
    if not sizes:
        return None
    each = max(1, min(each, rows // len(sizes)))
    # a bound on the hash lets twice the sample through, so that a common language is not ranked whole in one task
    share = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, 2 * each / n))))
    some = named.withColumn("__h", F.xxhash64(F.col("doc_id").cast("string"))).where(F.shiftrightunsigned("__h", 11) < share[F.col("lang")] * F.lit(float(1 << 53)))
    order = Window.partitionBy("lang").orderBy("__h", "doc_id")
    sample = some.select("doc_id", "lang", "__h").distinct().withColumn("__nth", F.row_number().over(order)).where(f"__nth <= {each}").select("doc_id", "lang")
    texts = docs.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v, c) for i, v, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (c := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())], names=["h", "lang", "counts"])

    met = texts.join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")
    got = sorted(((r["h"], r["lang"], r["counts"]) for r in met.mapInArrow(run, "h long, lang string, counts binary").toArrow().to_pylist()), key=lambda r: r)
    if not got:
        return None
    return fit(np.array([np.frombuffer(c, "<u4") for *_, c in got], np.float32), [v for _, v, _ in got])


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``accepted`` (the score reaches the model's bound) of every whole text.

    A kept column of one of these names is replaced. Languages of equal score go by name.
    A null text, and one without a letter, is ``und`` with score 0 and not accepted; so is all without a model. Repeated
    rows are predicted alike; an empty table gives an empty result.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "accepted")]
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                c = counts(t.as_py()) if own else None
                out.append(own.predict(c) if c is not None else ("und", 0.0))
            ok = [own is not None and v != "und" and s >= own.bound for v, s in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v for v, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64()), pa.array(ok, pa.bool_())], names=[*keep, "lang_pred", "score", "accepted"])

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder(F.col("doc_id"), 4) == 2
    out = identify(docs, train(docs.where(~held)), ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
