"""A corpus from raw documents to packed sequences, in five stages; each works on all that the one before kept.

Quality drops the documents that the classifier rejects. Near-duplicates leaves one document of each group, the one with
the least id. Secrets are masked in place, and ``n_chars`` follows. Mixing orders the rows by their place in the mixture,
so that reading the files in order reads the mixture. Packing takes that order: it packs consecutive ranges of it, numbers
sequences by range, and returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, packing, quality, secrets, simhash
from skein.llm.common import fewer, files, stored


#: Columns that stages read; all others go through a stage under a name that nothing in it can clash with.
READ = ("doc_id", "text", "source", "n_chars")


def held(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`").alias(c if c in READ else f"__c{i}") for i, c in enumerate(docs.columns)))


def released(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(c if c in READ else f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score reaches the bound. Null and empty texts are scored as empty ones, repeated rows alike.

    Without labelled documents every score is 0.5 and all stay. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.remainder(F.col("doc_id"), 5) != 0)
    own = held(docs)
    return released(quality.score(own, quality.train(own, labels), own.columns).where(F.col("score") >= quality.KEEP), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with shingles of five words alike to 0.8 or more, and one of repeated rows.

    The one with the least id, and of several rows with that id the one whose text has the least hash, stays. Texts
    without a word, null ones too, form one group. An empty table stays empty.
    """
    kept = simhash.similar_documents(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keyed = held(docs).withColumn("__text_hash", F.xxhash64("text"))
    met = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    return fewer(released(met.dropDuplicates(["doc_id", "__text_hash"]), docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span that any rule finds; all documents stay, repeated rows too. Null and empty texts stay as they are."""
    own = held(docs)
    found = secrets.scan(own, own.columns).withColumn("text", secrets.masked(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return released(found, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: over files, and within each. A null source is one of its own.

    A document's file follows from its position: positions are gapless, so nothing is sampled to deal them.
    """
    parts = files(spark)
    each = max(1, -(-docs.count() // parts))
    placed = mixing.mix(held(docs)).repartitionById(parts, F.expr(f"cast(position div {each} as int)"))
    return released(placed.sortWithinPartitions("position"), docs)


def in_file_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, text, position`` of the rows of Parquet files; position is gapless from 0, over files by name, and within each."""
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts, base, rows = {r[0]: r[1] for r in placed.groupBy("__file").count().collect()}, 0, []  # one number a file
    for file in sorted(counts):
        rows.append((file, base))
        base += counts[file]
    bases = spark.createDataFrame(rows, "__file string, __base long")
    return placed.join(F.broadcast(bases), "__file").select("doc_id", "text", (F.col("__base") + F.col("__row")).alias("position"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences, which follow the order of the files.

    Null and empty texts are the end id alone; repeated rows are packed each. An empty table gives no piece.
    """
    return fewer(packing.digest(packing.pack(in_file_order(spark, docs), order="position")))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifier, the automaton's masking and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
