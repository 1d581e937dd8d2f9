"""Near-duplicates by exact shingle similarity: against brute force, and the cases that fingerprints of words got wrong."""

import random

import pytest

from skein.llm import simhash

VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnop", k=2 + i % 6)) + str(i) for i in range(3000)]
ZIPF = [1 / (i + 1) for i in range(len(VOCABULARY))]


def zipf(n, seed):
    return random.Random(seed).choices(VOCABULARY, ZIPF, k=n)


def jaccard(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def components(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}


def test_extended_copies_are_found(spark):
    texts = []
    for i in range(150):
        n = 60 + 5 * i
        text = zipf(n, i)
        texts += [text, text + zipf(int((n - 4) * 0.24), 1000 + i)]
    close = [i for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    got = components(spark, texts)
    assert len(close) > 140 and all(got[i] == got[i + 1] for i in close)


@pytest.mark.parametrize("words", [9, 10, 11])
def test_a_repeated_line_links_nothing(spark, words):
    line = zipf(words, 7)
    texts = [random.Random(i).choices(VOCABULARY, k=100) + line * 20 for i in range(24)]
    assert components(spark, texts) == {i: i for i in range(len(texts))}


def test_similar_documents_equal_brute_force(spark):
    rng, texts = random.Random(3), []
    for i in range(12):
        base = zipf(80, 50 + i)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(80)] = "edit%d" % rng.randrange(10**6)
            texts.append(copy)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert 12 < len(set(label)) < len(texts)
    assert components(spark, texts) == dict(enumerate(label))
