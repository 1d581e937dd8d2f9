"""What the operators hold at a time: jobs of a search for components, the driver's arrays, texts sent to Python."""

import random
import weakref
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import common, components, quality, secrets, simhash, tokens


def least(edges):
    of = {x: x for e in edges for x in e}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {x: root(x) for x in of}


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stars_need_no_round(spark):
    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 200)], "u bigint, v bigint")
    cc, n = jobs(spark, "stars", lambda: components.connected_components(edges))
    assert {r.node: r.component for r in cc.collect()} == {i: i % 3 for i in range(200)}
    assert n <= 6


@pytest.mark.parametrize("seed", range(3))
def test_components_of_edges_that_come_later(spark, seed):
    pick = random.Random(seed)
    first, later = ([(pick.randrange(120), pick.randrange(120)) for _ in range(n)] for n in (60, 25))
    first, later = ([e for e in x if e[0] != e[1]] for x in (first, [*later, (500, 3), (501, 500)]))
    known = components.stars(spark.createDataFrame(first, "u bigint, v bigint"))
    both = components.joined_stars(known, spark.createDataFrame(later, "u bigint, v bigint"))
    assert {r.node: r.component for r in components.labelled(both).collect()} == least(first + later)
    none = components.joined_stars(known, spark.createDataFrame([], "u bigint, v bigint"))
    assert {r.node: r.component for r in components.labelled(none).collect()} == least(first)


def test_training_holds_features_in_one_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i} of a text") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen, descend = [], quality.descend
    monkeypatch.setattr(quality, "descend", lambda rows, values, *a: seen.extend([rows, values]) or descend(rows, values, *a))
    quality.train(docs, labels)
    assert all(len({id(x.base) for x in kind}) == 1 and kind[0].base is not None for kind in seen)
    assert all(np.all(np.diff(r) > 0) for r in seen[0])


def test_texts_are_sent_to_python_once(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh1", "x"), (2, None, None)], "doc_id bigint, text string, source string")
    model = quality.Model(np.zeros(quality.SIZE), 0.0, 1.0, 0.0)
    for keep in (["doc_id", "text", "source"], ["text", "doc_id"], ["doc_id"]):
        for out in (quality.score(docs, model, keep), secrets.scan(docs, keep)):
            assert out.columns[:-1] == keep and out.select(*keep).collect() == docs.select(*keep).collect()
            assert ("__text" in out._jdf.queryExecution().analyzed().toString()) == ("text" not in keep)
        assert [len(r.spans) for r in secrets.scan(docs, keep).collect()] == [1, 0]
    raw = docs.selectExpr("doc_id", "cast(text as binary) as text")
    assert [len(r.spans) for r in secrets.scan(raw, ["doc_id", "text"]).collect()] == [1, 0]


def test_narrow_tables_are_few_files(spark, monkeypatch):
    monkeypatch.setattr(common, "partitions", lambda spark: 400)
    rows = spark.range(5000).repartition(200)
    for narrow, files in ((False, 200), (True, 50)):
        out = common.stored(rows, "test", narrow=narrow)
        assert len(out.inputFiles()) == files and sorted(r.id for r in out.collect()) == list(range(5000))


def test_stored_tables_have_no_checksum_files(spark):
    rows = spark.range(300).selectExpr("id", "array(id, null) as ids", "cast(id as string) as text").repartition(3)
    out = common.stored(rows, "test")
    at = Path(out.inputFiles()[0].removeprefix("file://")).parent
    assert sorted(p.suffix for p in at.iterdir()) == ["", ".parquet", ".parquet", ".parquet"]  # a process for each file less
    assert sorted(out.collect()) == sorted(rows.collect())


def test_tables_of_texts_are_a_quarter_as_many_files(spark, monkeypatch):
    rows = spark.range(5000).repartition(200)
    for parts, files in ((400, 100), (60, 48), (12, 12)):
        monkeypatch.setattr(common, "partitions", lambda spark, n=parts: n)
        assert len(common.stored(common.fewer(rows), "test").inputFiles()) == files
    monkeypatch.setattr(common, "partitions", lambda spark: 240)
    docs = spark.range(900).selectExpr("id as doc_id", "concat('word ', id) as text", "cast(id % 3 as string) as source", "0L as n_chars")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert len(mixed.rdd.glom().map(len).collect()) == 60 and mixed.select("doc_id").distinct().count() == 900


@pytest.mark.parametrize("sender", ["quality", "secrets", "simhash"])
def test_a_worker_keeps_what_one_operator_needs(spark, monkeypatch, sender):
    docs, sent = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string"), []
    given = docs.select("doc_id", "text").toArrow().to_batches()[:0]

    def caught(self, run, schema):
        sent.append(run)
        raise InterruptedError

    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    send = {
        "quality": lambda: quality.score(docs, quality.Model(np.zeros(quality.SIZE), 0.0, 1.0, 0.0), ["doc_id"]),
        "secrets": lambda: secrets.scan(docs, ["doc_id"]),
        "simhash": lambda: simhash.similar_documents(docs),
    }[sender]
    with pytest.raises(InterruptedError):
        send()
    words = tokens.word_ids("word_bpe_49k.json")
    words.ids(b"some words")
    assert tokens.word_ids("word_bpe_49k.json") is words
    gone = weakref.ref(words)
    del words
    assert list(sent[0](iter(given))) == [] and gone() is None
    assert len(tokens.word_ids("word_bpe_49k.json").known) == 0
