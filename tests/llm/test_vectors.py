"""Search and near-duplicates of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, embed_dedup

SCHEMA = "vec_id bigint, embedding array<float>, uid string, score int, block int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((160, 16)).astype(np.float32)
    x[20:40] = x[20] + 0.05 * rng.standard_normal((20, 16)).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), "clash", 1, 2) for i, v in enumerate(x)]
    rows += [(1000, None, None, None, None), (1001, [0.0] * 16, "", 0, 0), (1002, [float("nan")] * 16, "", 0, 0), (1003, [1.0, None] * 8, "", 0, 0), (1004, [float("inf")] * 16, "", 0, 0), (1005, [1.0, 2.0], "", 0, 0), (1006, [], "", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA), x.astype(np.float64)


def cosine(x):
    n = np.sqrt((x * x).sum(1))
    return (x @ x.T) / np.outer(n, n)


@pytest.mark.parametrize("tile", [4096, 32])
def test_embed_dedup(table, tile):
    df, x = table
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, tile=tile).collect()}
    near = cosine(x) >= 0.95 - 1e-12
    label = np.arange(len(x))
    for _ in x:
        label = np.array([label[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, label[i], label[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1007))
    assert len(got) == len(x) + 7


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 24))
    raw = {"dim": 24, "uids": np.arange(200, dtype="<i8").tobytes(), "extra": np.ones(200, "<i8").tobytes(), "vectors": x.astype("<f8").tobytes()}
    c = embed_dedup.Codes(raw)
    estimate = (c.q @ c.q.T) * np.outer(c.scale, c.scale)
    bound = c.error[:, None] + (1 + c.error[:, None]) * c.error[None, :]
    assert (np.abs(estimate - cosine(x)) <= bound).all()


@pytest.mark.parametrize("block", [8192, 40])
def test_ann(table, block):
    df, x = table
    got = ann.search(df, F.col("vec_id") % 10 == 0, block=block).collect()
    c = cosine(x)
    hits = 0
    for q in range(0, len(x), 10):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        order = [i for i in sorted(range(len(x)), key=lambda i: (-round(c[q, i], 12), i)) if i != q][:5]
        hits += len(set(order) & {r[1] for r in own})
        assert all(abs(c[q, i] - s) < 1e-12 for _, i, s in own)
    assert hits >= 0.95 * 5 * 16
    assert {r.query_id for r in got} == set(range(0, 160, 10))


def test_empty(spark, table):
    none = table[0].limit(0)
    assert embed_dedup.near_duplicates(none).count() == 0 and ann.search(none, F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], "", 0, 0), (2, [1.0, 1.0], "", 0, 0), (2, [1.0, 1.0], "", 0, 0)], SCHEMA)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(two, F.lit(True)).collect()) == [(1, 1, 2), (2, 1, 1)]
