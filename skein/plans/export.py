"""Exports: the catalog's tables as JSON, each sorted by its id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUARANTINED = ["source", "source_record_id", "event_key"]
ORDER = {"listing": ["listing_id"], "decision": ["listing_id"], "product": ["id"], "variant": ["id"], "offer": ["id"], "observation": ["offer", "seq"], "audit": ["seq", "listing"]}


def normalized_listings(listings: DataFrame) -> DataFrame:
    """Listings with a reference for each piece of provenance: ``<record>-prov-<i>``."""
    refs = F.transform("provenance", lambda p, i: p.withField("provenance_ref", F.concat_ws("-prov-", F.col("source_record_id"), i.cast("string"))))
    return listings.withColumn("provenance", refs)


def decisions(d: DataFrame) -> DataFrame:
    """One row a listing; a missing decision is an abstention."""
    return d.withColumn("decision", F.coalesce("decision", F.lit("REVIEW")))


def stats(t: dict[str, DataFrame], quarantine: DataFrame) -> DataFrame:
    """``entity, n`` of every table, and their total of products, variants and offers."""
    counts = None
    for name, df in [*t.items(), ("quarantine", quarantine)]:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        counts = one if counts is None else counts.unionAll(one)
    total = counts.where(F.col("entity").isin("product", "variant", "offer")).agg(F.sum("n").alias("n")).select(F.lit("catalog_entity_count").alias("entity"), "n")
    return counts.unionAll(total)


# Sections of the combined document.
SECTIONS = {
    "normalized_listings": "listing", "universal_products": "product", "variants": "variant", "offers": "offer", "observations": "observation", "resolution_decisions": "decision", "resolution_history": "audit",
    "quarantine": "quarantine", "stats": "stats",
}


def combined(t: dict[str, DataFrame], quarantine: DataFrame) -> DataFrame:
    """``section, id, document``: everything an export holds as JSON objects, one a row, so that no section is gathered."""
    shaped = t | {"listing": normalized_listings(t["listing"]), "decision": decisions(t["decision"]), "quarantine": quarantine, "stats": stats(t, quarantine)}
    keys = ORDER | {"quarantine": QUARANTINED, "stats": ["entity"]}
    rows = [shaped[n].select(F.lit(s).alias("section"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys[n])).alias("id"), F.to_json(F.struct("*")).alias("document")) for s, n in SECTIONS.items()]
    return reduce(DataFrame.unionAll, rows)


def write(t: dict[str, DataFrame], quarantine: DataFrame, path: str, document: bool = False) -> None:
    """One folder of JSON lines for each table, and the combined document if wanted. Sorting is by range, so files in order are the table in order."""
    shaped = t | {"listing": normalized_listings(t["listing"]), "decision": decisions(t["decision"])}
    for name, df in shaped.items():
        df.orderBy(*ORDER[name]).write.mode("overwrite").json(f"{path}/{name}")
    quarantine.orderBy(*QUARANTINED).write.mode("overwrite").json(f"{path}/quarantine")
    stats(t, quarantine).coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    if document:
        combined(t, quarantine).orderBy("section", "id").write.mode("overwrite").json(f"{path}/document")
