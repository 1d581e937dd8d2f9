"""Evidence as long rows ``(listing, key, value, derivation, ord)`` and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import titles
from skein.functions.text import clean
from skein.operators.graph import spread
from skein.sources.policy import Policy, dims_of


def rank(derivation: Column) -> Column:
    """Stated outright before read from a title before inferred."""
    return F.when(derivation == "explicit", 3).when(derivation == "normalized", 2).when(derivation == "inferred", 1).otherwise(0)


def title_evidence(rows: DataFrame, title: Column, field: Column, *keep: str) -> DataFrame:
    """``keep`` and ``a``, a row for each attribute of each title.

    The clean title is a column before anything reads it, so that its expression is not repeated in every pattern, and rows
    are dealt over tasks by then. Slots are exploded with their nulls: no filter on the array repeats the patterns.
    """
    read = spread(rows.select(*keep, clean(title).alias("__title"), field.alias("__field")))
    read = read.select(*keep, titles.slots(F.col("__title"), F.col("__field"), cleaned=True).alias("__slots"))
    return read.select(*keep, F.explode_outer("__slots").alias("a")).where("a is not null")


def split_known(attrs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``known``: whether the key may be state. Others are kept as unknown attributes."""
    return attrs.withColumn("known", F.col("key").isin(keys))


def precedence(attrs: DataFrame) -> DataFrame:
    """``listing, key, value, conflicting``: the first of the highest rank, and whether its equals in rank disagree.

    One aggregation: the least (-rank, ord) carries the value; values of the top rank are compared by their extremes.
    """
    top = F.max(rank(F.col("derivation"))).over(Window.partitionBy("listing", "key"))
    best = attrs.withColumn("__top", top).where(rank(F.col("derivation")) == F.col("__top"))
    low = F.lower(F.trim("value"))
    return best.groupBy("listing", "key").agg(F.min_by("value", "ord").alias("value"), (F.min(low) != F.max(low)).alias("conflicting"))


def wide(attrs: DataFrame) -> DataFrame:
    """``listing, attributes map<key, value>``."""
    return attrs.groupBy("listing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))


def critical_dims(listings: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """Adds ``dims``, the asserted attributes that the category's policy names; needs category and attributes."""
    own = dims_of(F.col("category"), policies)
    return listings.withColumn("dims", F.map_filter("attributes", lambda k, v: F.array_contains(own, k) & v.isNotNull()))
