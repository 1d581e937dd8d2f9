"""Weighted rendezvous hashing of stable record keys to shards.

Every (key, shard) pair has a hash u in (0, 1) and a score -weight / ln(u); a record goes to the shard with the highest
score. A shard's share is proportional to its weight, and a further shard takes records only into itself, since the
other scores stay. All is built-in expressions: no shard table is joined and nothing is broadcast.

Slots number a shard's records from 0. They are ranks in salted groups plus the groups' sizes, so a shard of any size
is ranked in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import salt


def _score(keys: Sequence[Column], shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard"))


def shard_of(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard, from 0, of a record with these key columns; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return (-F.array_max(F.array(*(_score(keys, s, w) for s, w in enumerate(weights)))).getField("shard")).cast("int")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", grown: float | None = 1.0) -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` for each row of docs.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` the CRC-32 of these bytes (null text: none). ``slot`` is
    gapless from 0 in each shard. ``grown_shard`` is where the record goes once a shard of weight ``grown`` is added.
    Repeated rows have one shard and a slot each; rows of a null key share a shard. An empty table gives an empty
    result. Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keys = [F.col(key).cast("string")]  # the id's text, so that an id's type does not move it
    rows = docs.select(key, (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({
        "shard": shard_of(keys, weights),
        "grown_shard": F.lit(None).cast("int") if grown is None else shard_of(keys, [*weights, grown]),
        "salt": salt(docs.sparkSession, F.col(key), F.col("text_crc32"), F.col("size")),
    })
    groups = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("shard", "salt").orderBy(key, "text_crc32", "size"))
    placed = rows.withColumn("rank", inner).join(groups, ["shard", "salt"])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", files: int = 1) -> None:
    """Writes docs as Parquet, one folder a shard, at most ``files`` files each, dealt by a hash of the key."""
    out = docs.withColumns({"shard": shard_of([F.col(key).cast("string")], weights), "__file": F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(files))})
    out.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
