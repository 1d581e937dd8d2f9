"""Offers from observations, and whether a variant's prices compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import sha16


def offer_id(seller: Column, number: Column, condition: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(seller, F.lit(""))))
    return F.concat(F.lit("of:"), sha16(F.concat_ws("|", low, number, F.coalesce(condition, F.lit("new")))))


def product_id(category: Column, brand: Column, root: Column, generation: Column) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.concat(F.lit("up:"), sha16(F.concat_ws("|", F.coalesce(category, F.lit("unknown")), low(brand), low(root), low(generation))))


def variant_id(product: Column, dims: Column) -> Column:
    """Of a product and its dimensions, sorted by key."""
    parts = F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), F.lower(e["value"])))
    return F.concat(F.lit("var:"), sha16(F.concat(product, F.array_join(parts, ""))))


def roll_up(observations: DataFrame) -> DataFrame:
    """``offer, price, observed_at, comparability, n_observations, listings``: the latest clock, then the latest arrival.

    One aggregation with map-side combination; the latest is carried as a struct.
    """
    latest = F.max(F.struct("observed_at", "seq", "price", "comparability"))
    out = observations.groupBy("offer").agg(latest.alias("__o"), F.count("*").alias("n_observations"), F.array_sort(F.collect_set("listing")).alias("listings"))
    return out.select("offer", F.col("__o.price").alias("price"), F.col("__o.observed_at").alias("observed_at"), F.col("__o.comparability").alias("comparability"), "n_observations", "listings")


def current(observations: DataFrame) -> DataFrame:
    """``offer, variant, price, comparability, active``: the latest price, and whether any observation is active; one aggregation."""
    latest = F.max(F.struct("observed_at", "seq", "price", "comparability"))
    out = observations.groupBy("offer").agg(latest.alias("__o"), F.bool_or("active").alias("active"), F.min("variant").alias("variant"))
    return out.select("offer", "variant", F.col("__o.price").alias("price"), F.col("__o.comparability").alias("comparability"), "active")


def variant_comparability(offers: DataFrame) -> DataFrame:
    """``variant, n_active, comparability, best_price``: unknown without an active offer, comparable if all active ones are."""
    active = F.col("active")
    out = offers.groupBy("variant").agg(F.count_if(active).alias("n_active"), F.every(~active | (F.col("comparability") == "COMPARABLE")).alias("__all"), F.min(F.when(active & (F.col("comparability") == "COMPARABLE"), F.col("price"))).alias("best_price"))
    kind = F.when(F.col("n_active") == 0, "UNKNOWN").when(F.col("__all"), "COMPARABLE").otherwise("CONDITIONAL")
    return out.select("variant", "n_active", kind.alias("comparability"), "best_price")
