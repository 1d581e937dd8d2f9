"""Candidate generation by equi-joins on exploded keys, with its telemetry.

A listing never meets itself, and nothing is truncated: block sizes are reported instead. The side that is looked up is
reduced to its entities before the join: whether an entity has a member besides the listing follows from the number of
its members under the key and one of them. So a hot key costs a row for each of its entities, not for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entities(build: DataFrame, *more: str) -> DataFrame:
    """``build(member, entity, key)`` -> ``key, entity, more..., members, one``: whether it has one member or (2) several, and the least of them."""
    per = build.groupBy("key", "entity", *more).agg(F.min("member").alias("one"), F.max("member").alias("__last"))
    return per.select("key", "entity", *more, F.when(F.col("one") == F.col("__last"), 1).otherwise(2).alias("members"), "one")


def others() -> Column:
    """An entity of ``entities`` has a member other than ``listing``."""
    return (F.col("members") > 1) | (F.col("one") != F.col("listing"))


def block(probe: DataFrame, build: DataFrame, index: str, strength: int) -> DataFrame:
    """``probe(listing, key)`` and ``build(member, entity, key)`` -> ``listing, entity, index, strength``, once each."""
    met = probe.join(entities(build), "key").where(others())
    return met.select("listing", "entity", F.lit(index).alias("index"), F.lit(strength).alias("strength")).distinct()


def block_counts(probe: DataFrame, build: DataFrame) -> DataFrame:
    """``listing, n``: how many entities ``block`` finds for each listing of one key, without listing them.

    An entity of the key counts unless the listing is its only member, so a key's entities are counted once.
    """
    per = entities(build)
    sizes = per.groupBy("key").agg(F.count("*").alias("__entities"))
    alone = per.where("members = 1").groupBy("key", F.col("one").alias("listing")).agg(F.count("*").alias("__alone"))
    met = probe.select("listing", "key").distinct().join(sizes, "key").join(alone, ["key", "listing"], "left")
    return met.select("listing", (F.col("__entities") - F.coalesce("__alone", F.lit(0))).alias("n")).where("n > 0")


def block_sizes(keys: DataFrame) -> DataFrame:
    """``key, n, pairs``: how many share a key, and the pairs that makes."""
    return keys.groupBy("key").agg(F.count_distinct("listing").alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1)).cast("long"))


def telemetry(candidates: DataFrame) -> DataFrame:
    """``listing, candidates map<index, entities>, candidate_count``; the count is of the union."""
    per = candidates.groupBy("listing", "index").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    out = per.groupBy("listing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("index", "entities")))).alias("candidates"))
    return out.withColumn("candidate_count", F.size(F.array_distinct(F.flatten(F.map_values("candidates")))))


def support(candidates: DataFrame) -> DataFrame:
    """``listing, entity, strength``: the strongest index."""
    return candidates.groupBy("listing", "entity").agg(F.max("strength").alias("strength"))


def top_stratum(supported: DataFrame) -> DataFrame:
    """All entities of a listing's highest strength; Spark limits ranks before the shuffle."""
    order = Window.partitionBy("listing").orderBy(F.desc("strength"))
    return supported.withColumn("__r", F.rank().over(order)).where("__r = 1").drop("__r")


def category_fits(a, b):
    """Unknown fits every category."""
    a, b = (F.coalesce(c, F.lit("unknown")) for c in (a, b))
    return (a == "unknown") | (b == "unknown") | (a == b)


def generation_clashes(a, b):
    """Both name a generation, and not the same."""
    return F.coalesce(F.lower(F.trim(a)) != F.lower(F.trim(b)), F.lit(False))


def viable(dims, attrs):
    """All of a listing's dimensions are in the variant, and equal."""
    return F.forall(F.map_entries(dims), lambda e: F.coalesce(F.lower(F.trim(F.try_element_at(attrs, e["key"]))) == F.lower(F.trim(e["value"])), F.lit(False)))


def conflicts(dims, attrs):
    """A shared dimension differs."""
    return F.exists(F.map_entries(dims), lambda e: F.coalesce(F.lower(F.trim(F.try_element_at(attrs, e["key"]))) != F.lower(F.trim(e["value"])), F.lit(False)))
