"""The pipeline's near-duplicate stage has operator 1's links among its candidates."""

import random

from skein.llm import simhash


def texts(n=40):
    out = []
    for i in range(n):
        words = [f"w{random.Random(i).randrange(10**6)}x{k}" for k in range(300)]
        out += [" ".join(words), " ".join([*words[:-1], "edit"])]
    return out


def test_pairs_of_near_fingerprints_are_found_without_minhash(spark):
    """With a MinHash key of so many hashes that only equal sets share it, the pairs that operator 1 links are still found, and decided exactly."""
    far = texts()
    near = {i for i in range(0, len(far), 2) if (simhash.fingerprint(far[i].encode()) ^ simhash.fingerprint(far[i + 1].encode())).bit_count() <= 4}
    assert len(near) > 10

    docs = spark.createDataFrame(list(enumerate(far)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, tables=1, rows=2000).collect()}
    assert all(got[i + 1] == i for i in near) and all(got[i] == i for i in range(0, len(far), 2))


def test_a_text_that_many_meet_is_sent_in_parts(spark, monkeypatch):
    """Every pair of a large star is decided once, whatever the parts it is dealt over."""
    monkeypatch.setattr(simhash, "STAR", 8)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[: 200 - i], *(f"e{i}x{k}" for k in range(i))])) for i in range(1, 60)]
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 60)], "u long, v long")
    found = simhash._checked(pairs, spark.createDataFrame(rows, "id long, text string"), 5, simhash.Fraction("0.8")).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    assert sorted((r.u, r.v, r.ok) for r in found) == [(i, 0, len(sets[i] & sets[0]) >= 0.8 * len(sets[i] | sets[0])) for i in range(1, 60)]
