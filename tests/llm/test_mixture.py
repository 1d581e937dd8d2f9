"""The mixture's weights in the packed windows."""

from collections import Counter

import corpus_pipeline
from skein.llm import mixing, packing
from tests.llm.test_text_operators import prose


def test_windows_follow_the_mixture(spark, tmp_path):
    rows = [(i, prose(40 + i % 37, i), "big" if i < 1800 else "small") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    placed = corpus_pipeline.in_file_order(spark, spark.read.parquet(str(tmp_path / "mixed")))
    order = {r.doc_id: r.position for r in placed.select("doc_id", "position").collect()}
    assert order == {r.doc_id: r.position for r in mixing.mix(docs).collect()}  # the files hold the mixture
    pieces = packing.pack(placed, window=256, quantum=32, order="position", span=128).select("doc_id", "length", "sequence_id", "offset").collect()
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert sorted(filled) == list(range(len(filled))) and sum(n < 256 for n in filled.values()) <= 1
    # weights are the square roots of 1,800 and 200: 3 to 1, until the small source ends after 800 documents
    shares = []
    for lo in range(0, len(filled), len(filled) // 10):
        own = [p for p in pieces if lo <= p.sequence_id < lo + len(filled) // 10]
        shares.append(sum(p.length for p in own if p.doc_id >= 1800) / sum(p.length for p in own))
    assert all(0.15 < s < 0.35 for s in shares[:3]) and all(s < 0.02 for s in shares[5:10]), shares
