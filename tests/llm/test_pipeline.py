"""The pipeline's stages on a small corpus, and the optional subpackage's absence."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
from skein.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, tmp_path):
    from tests.llm.test_text_operators import BASE, edited, prose

    texts = [BASE, BASE, edited(BASE, 100), prose(80, 1), "SHOUT!! " * 60, prose(30, 5) + " password = hunter2hunter2", prose(70, 2), None, ""]
    texts += [prose(60, 100 + i) for i in range(120)] + [" ".join(w.upper() + "!!" for w in prose(50, 400 + i).split()) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 129), 0) for i in range(9, 189)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert not ids["quality"] & set(range(129, 189)) and set(range(9, 129)) <= ids["quality"]
    assert 0 in ids["near_duplicates"] and not ids["near_duplicates"] & {1, 2} and set(range(9, 129)) <= ids["near_duplicates"]
    (masked,) = [r for r in kept["secrets"] if r.doc_id == 5]
    assert "hunter2" not in masked.text and masked.n_chars == len(masked.text)
    assert ids["mixing"] == ids["secrets"] == ids["packing"] == ids["near_duplicates"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == docs.columns and whole.count() >= len(ids["mixing"])


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_the_rest_imports_without(tmp_path):
    for name in ("skein", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "skein/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'offer_rollup' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
