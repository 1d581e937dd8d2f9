"""Conformance checks over the catalog's tables: one row a check, with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.policy import DEFAULT, Policy, built_in, table


# What provenance must distinguish, and the invalid evidence that it must keep.
VOCABULARY = {"derivation": ["explicit", "normalized", "inferred"], "validity": ["invalid", "conflicting"]}


def violations(df: DataFrame, **bad: Column) -> DataFrame:
    """How many rows fail each check, of all checks in one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(b, F.lit(True))).alias(name) for name, b in bad.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in bad))).alias("c")).select("c.*")


def orphans(child: DataFrame, key: str, parent: DataFrame, id_: str, name: str) -> DataFrame:
    """Children whose parent is not there."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(id_).alias(key)), key, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def same_ids(a: DataFrame, b: DataFrame, id_: str, name: str) -> DataFrame:
    both = a.select(id_).exceptAll(b.select(id_)).unionAll(b.select(id_).exceptAll(a.select(id_)))
    return both.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def variant_safety(attrs: DataFrame) -> DataFrame:
    """``variant, dim, n``: dimensions with several values among a variant's listings; ``attrs(variant, dim, value)``."""
    return attrs.groupBy("variant", "dim").agg(F.count_distinct(F.lower(F.trim("value"))).alias("n")).where("n > 1")


def partitions(members: DataFrame) -> DataFrame:
    """``members``: sorted listings of each cluster, so that two catalogs compare whatever their ids are."""
    return members.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("listing")), ",").alias("members")).select("members")


def same_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    return same_ids(partitions(a), partitions(b), "members", "partitions")


def vocabulary(provenance: DataFrame) -> DataFrame:
    """Words that a catalog's provenance must use somewhere; ``provenance(derivation, validity)``. Only words are collected."""
    seen = provenance.agg(F.collect_set("derivation").alias("derivation"), F.collect_set("validity").alias("validity"))
    lost = [F.struct(F.lit(f"provenance_{c}").alias("check"), F.size(F.array_except(F.array(*map(F.lit, words)), c)).cast("long").alias("violations")) for c, words in VOCABULARY.items()]
    return seen.select(F.explode(F.array(*lost)).alias("c")).select("c.*")


def unpinned(listings: DataFrame, variants: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """``variant, dim``: price-critical dimensions of matched listings that a listing of the variant asserts but the variant lacks.

    ``listings(category, decision, variant_id, attributes)``, ``variants(id, attrs)``. Categories without a policy have none.
    """
    critical = F.broadcast(table(listings.sparkSession, policies or built_in()).where((F.col("role") == "price_critical") & (F.col("category") != DEFAULT)).select("category", "dim").distinct())
    asserted = listings.where("variant_id is not null").select(F.col("variant_id").alias("variant"), F.explode("attributes").alias("dim", "value")).where("value is not null").select("variant", "dim").distinct()
    matched = listings.where("decision = 'MATCH' and variant_id is not null").select("category", F.col("variant_id").alias("variant")).distinct()
    held = variants.select(F.col("id").alias("variant"), F.explode(F.map_keys("attrs")).alias("dim"))
    needed = matched.join(critical, "category").select("variant", "dim").distinct()
    return needed.join(asserted, ["variant", "dim"], "left_semi").join(held, ["variant", "dim"], "left_anti")


def lost_assignments(audit: DataFrame, observations: DataFrame) -> DataFrame:
    """Audited changes whose earlier assignment no observation before them keeps; ``audit(record, seq, prior, new)``, ``observations(record, seq, value)``."""
    first = observations.groupBy("record", F.col("value").alias("prior")).agg(F.min("seq").alias("__first"))
    return audit.join(first, ["record", "prior"], "left").where("__first is null or __first >= seq").drop("__first")


def pairs_agree(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labelled pairs with ``passed``; both must match. ``pairs(a, b, same_product, same_variant)``."""
    side = lambda s: decisions.select(F.col("source_record_id").alias(s), F.col("decision").alias(f"d{s}"), F.col("universal_product_id").alias(f"p{s}"), F.col("variant_id").alias(f"v{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    ok = (F.col("da") == "MATCH") & (F.col("db") == "MATCH") & ((F.col("pa") == F.col("pb")) == F.col("same_product")) & ((F.col("va") == F.col("vb")) == F.col("same_variant"))
    return met.select("a", "b", ok.alias("passed"))


def conformance(t: dict[str, DataFrame], policies: dict[str, Policy] | None = None) -> DataFrame:
    """All checks that hold for every catalog; ``check, violations``."""
    policies = policies or built_in()
    spark = t["listing"].sparkSession
    l, d, o, b = t["listing"], t["decision"], t["offer"], t["observation"]
    kinds = ["MATCH", "REVIEW", "NO_MATCH"]
    comparable = ["COMPARABLE", "CONDITIONAL", "NOT_COMPARABLE", "UNKNOWN"]
    union = F.array_distinct(F.flatten(F.map_values("candidates")))
    critical = table(spark, policies).where("role != 'product'").select("category", "dim").distinct()
    flat = l.where("variant_id is not null").select("category", F.col("variant_id").alias("variant"), F.explode("attributes").alias("dim", "value"))
    named = flat.join(critical.select("category").distinct(), "category", "left_semi").join(critical, ["category", "dim"], "left_semi")
    other = flat.join(critical.select("category").distinct(), "category", "left_anti").join(critical.where(F.col("category") == DEFAULT).select("dim"), "dim", "left_semi").select("category", "dim", "variant", "value")
    unsafe = variant_safety(named.select("variant", "dim", "value").unionAll(other.select("variant", "dim", "value")))
    out = [
        violations(
            l, listing_ids=F.col("listing_id").isNull() | F.col("source_record_id").isNull(), raw_kept=F.col("raw").isNull(), attributes_have_provenance=(F.size("attributes") > 0) & (F.size("provenance") == 0),
            category_set=F.col("category").isNull(), unknown_attributes_kept=F.col("unknown_attributes").isNull(),
        ),
        orphans(t["variant"], "product", t["product"], "id", "variants_have_products"), orphans(o, "variant", t["variant"], "id", "offers_have_variants"),
        violations(o, offer_price_kind=F.col("price_kind").isNull(), offer_comparability=~F.col("comparability").isin(comparable), offer_seller_condition=F.col("condition").isNull(), offer_sources=F.size("records") == 0),
        orphans(o.withColumnRenamed("id", "offer"), "offer", b, "offer", "offers_have_observations"),
        violations(
            b, observation_event_key=F.col("event_key").isNull(), conditional_has_terms_or_hint=(F.col("comparability") == "CONDITIONAL") & F.col("terms").isNull(),
            installments_do_not_compare=(F.col("price_kind") == "monthly_installment") & (F.col("comparability") == "COMPARABLE"),
        ),
        same_ids(l, d, "listing_id", "one_decision_a_listing"),
        violations(
            d, decision_kind=~F.col("decision").isin(kinds), candidate_count=F.col("candidate_count") != F.size(union), scored_are_candidates=F.size(F.array_except("scored", union)) > 0,
            match_has_signals=(F.col("decision") == "MATCH") & (F.size("positive") == 0), review_has_no_variant=(F.col("decision") != "MATCH") & F.col("variant_id").isNotNull(),
            ambiguity_has_hypotheses=(F.col("decision") == "REVIEW") & (F.col("candidate_count") > 1) & (F.size("hypotheses") == 0),
        ),
        violations(t["audit"], audit_complete=F.col("listing").isNull() | F.col("reason").isNull() | F.col("seq").isNull()),
        unsafe.agg(F.count("*").alias("violations")).select(F.lit("variant_safety").alias("check"), "violations"),
    ]
    return reduce(DataFrame.unionAll, out)
