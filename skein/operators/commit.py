"""From the event log to the catalog: components of events, folded in parallel.

Keys of an event: its record, the record it corrects, exact codes, codes, the seller's number, model tokens. A record's
keys are the union over its events, so what a later event leaves out still connects; coarser components stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.money import comparability
from skein.functions.text import canonical_value, fallback_tokens, family, family_tokens, full_codes, squeeze
from skein.operators.fold import Component
from skein.operators.graph import checkpointed, components, written
from skein.sources import log as event_log
from skein.sources.adapters import Adapter
from skein.sources.events import effective_mode
from skein.sources.policy import Policy, built_in, canonical_keys

KINDS = ["listing", "decision", "product", "variant", "offer", "observation", "audit"]


def prepared(log: DataFrame, adapters: list[Adapter] | None = None) -> DataFrame:
    """Log rows with status, mode, quarantine reason, clocks, evidence and tokens: all that the fold reads."""
    out = event_log.classify(event_log.keyed(log.drop("event_key", "payload_hash"), adapters))
    out = out.withColumn("mode", effective_mode(F.col("operation"), F.col("update_mode"))).withColumn("reason", event_log.reason(F.col("status"), F.col("adapter"), F.col("x")))
    clock = lambda c: F.unix_micros(F.try_to_timestamp(c))
    coded = F.filter("x.identifiers", lambda i: i["ns"].isin("mpn", "style_code") & i["raw"].isNotNull())
    m = F.col("x.money")
    ids = F.transform("x.identifiers", lambda i: F.struct(*(i[c].alias(c) for c in ("ns", "raw", "canonical", "scope", "validity", "source_field")), F.when(i["ns"].isin("mpn", "style_code"), family(i["raw"])).alias("family")))
    attrs = F.transform("x.attrs", lambda a: F.struct(a["key"].alias("key"), a["kind"].alias("kind"), F.when(a["kind"] == "string", canonical_value(a["key"], a["value"])).otherwise(a["value"]).alias("value"), a["raw"].alias("raw"), a["source_field"].alias("source_field"), a["derivation"].alias("derivation")))
    return out.withColumns({
        "corrects": F.col("corrects_listing_id"), "clock": clock(F.coalesce("source_updated_at", "x.source_updated_at", "x.observed_at")), "observed_clock": clock(F.col("x.money.observed_at")),
        "title_tokens": family_tokens(F.col("x.title")), "title_codes": full_codes(F.col("x.title")), "fallback": fallback_tokens(F.col("x.title"), F.col("x.brand")),
        "id_tokens": F.array_distinct(F.flatten(F.transform(coded, lambda i: family_tokens(i["raw"])))), "id_codes": F.filter(F.transform(coded, lambda i: squeeze(i["raw"])), lambda c: c.isNotNull()),
        "attrs": attrs, "comparability": comparability(m["comparability"], m["amount"], m["price_kind"], m["terms"], F.col("x.condition")), "x": F.col("x").withField("identifiers", ids),
    })


def event_keys(events: DataFrame) -> DataFrame:
    """``a`` (the record's key) and ``b`` (any key of it), for the component graph."""
    rec = F.concat_ws("|", F.lit("rec"), "source", "x.record_id")
    tagged = lambda tag, array: F.transform(array, lambda v: F.concat(F.lit(f"{tag}:"), v))
    exact = F.filter("x.identifiers", lambda i: i["canonical"].isNotNull())
    codes = F.concat(F.transform(exact, lambda i: F.concat_ws(":", F.when(i["ns"] == "gtin", "gtin").otherwise("code"), i["canonical"])), tagged("code", F.concat("title_codes", "id_codes")))
    tokens = F.concat("title_tokens", "id_tokens")
    named = tagged("tok", F.when(F.size(tokens) > 0, tokens).otherwise(F.when(F.size("fallback") > 0, F.col("fallback")).otherwise(F.array(F.lit("")))))
    record = F.array(F.concat(F.lit("rid:"), F.col("x.record_id")), F.concat(F.lit("rid:"), F.col("corrects")))
    flat = events.select(rec.alias("a"), F.explode(F.concat(codes, named, record)).alias("b")).where("b is not null")
    # sellers and numbers carry over between a record's events: all pairs of the two
    pairs = events.groupBy(rec.alias("a")).agg(F.collect_set(F.lower(F.trim(F.coalesce("x.seller", F.lit(""))))).alias("s"), F.collect_set("x.merchant_sku").alias("k"), F.collect_set("fallback").alias("f"))
    skus = pairs.select("a", F.explode("s").alias("__s"), "k").select("a", "__s", F.explode("k").alias("__k")).select("a", F.concat_ws("|", F.lit("sku"), "__s", "__k").alias("b"))
    mixed = pairs.join(events.where(F.size(tokens) == 0).select(rec.alias("a")).distinct(), "a", "left_semi").select("a", F.explode(F.flatten("f")).alias("t")).select("a", F.concat(F.lit("tok:"), "t").alias("b"))
    return flat.unionAll(skus).unionAll(mixed).distinct()


def linked(keys: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of records alone, with their components: each to the least record under its key, a key of one record to itself."""
    keys = checkpointed(keys)
    return keys.join(keys.groupBy("b").agg(F.min("a").alias("least")), "b").select("a", F.col("least").alias("b")).distinct()


def _batches(state: Component) -> Iterator[pa.RecordBatch]:
    rows = state.rows()
    while part := list(islice(rows, 1024)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names=["kind", "id", "doc"])


def catalog(log: DataFrame, policies: dict[str, Policy] | None = None, adapters: list[Adapter] | None = None) -> dict[str, DataFrame]:
    """The catalog of a log: ``entities(kind, id, doc)``, ``quarantine``, ``classified`` and ``components(component, n)``."""
    policies = built_in() if policies is None else policies
    ready = checkpointed(prepared(log, adapters))
    good = ready.where("status = 'new' and reason is null")
    of = components(linked(event_keys(good)))
    placed = good.withColumn("__rec", F.concat_ws("|", F.lit("rec"), "source", "x.record_id")).join(of.withColumnRenamed("node", "__rec"), "__rec").drop("__rec")
    columns = ["component", "seq", "source", "event_key", "mode", "corrects", "clock", "observed_clock", "received_at", "null_semantics", "adapter", "payload", "x", "attrs", "title_tokens", "title_codes", "fallback", "id_tokens", "id_codes", "comparability"]
    known = set(canonical_keys(policies))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Component(policies, known)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for event in batch.slice(lo, 256).to_pylist():
                    if event["component"] != now:
                        yield from _batches(state)
                        now, state = event["component"], Component(policies, known)
                    state.apply(event)
        yield from _batches(state)

    # a component's events come together and in order, so a task holds their state, not the events
    ordered = placed.select(columns).repartition("component").sortWithinPartitions("component", "seq")
    entities = written(ordered.mapInArrow(fold, "kind string, id string, doc string"), "kind")
    quarantine = ready.where("reason is not null").dropDuplicates(["event_key", "payload_hash"]).select("source", F.coalesce("record_id", F.concat(F.lit("unidentified:"), "payload_hash")).alias("source_record_id"), "reason", "event_key", F.col("payload").alias("raw"))
    return {"entities": entities, "quarantine": quarantine, "classified": ready, "components": placed.groupBy("component").agg(F.count("*").alias("n"))}


SCHEMAS = {
    "listing": "listing_id string, source string, source_record_id string, lifecycle string, category string, attributes map<string,string>, unknown_attributes map<string,string>, provenance array<struct<canonical_field:string,source_field:string,raw_value:string,normalized_value:string,derivation:string,validity:string,event_key:string>>, history array<struct<event_key:string,update_mode:string,observed_at:string,received_at:string,adapter:string,applied:boolean>>, identifiers array<struct<ns:string,raw:string,canonical:string,scope:string,validity:string,source_field:string>>, tokens array<string>, family array<string>, raw string, universal_product_id string, variant_id string, missing_critical_dims array<string>, seller string, sku string, title string, brand string, origin string, type string, observed string, condition string",
    "decision": "listing_id string, source string, source_record_id string, decision string, confidence double, universal_product_id string, variant_id string, positive array<struct<canonical_field:string,raw_value:string,note:string>>, negative array<struct<canonical_field:string,raw_value:string,note:string>>, hypotheses array<struct<universal_product_id:string,variant_id:string,score:double>>, candidates map<string,array<string>>, candidate_count int, scored array<string>",
    "product": "id string, category string, brand string, attrs map<string,string>, listings array<string>, variants array<string>",
    "variant": "id string, product string, attrs map<string,string>, listings array<string>",
    "offer": "id string, seller string, condition string, listings array<string>, records array<string>, active boolean, price double, list_price double, currency string, price_kind string, comparability string, terms string, observed_at string, product string, variant string",
    "observation": "offer string, event_key string, listing string, price double, list_price double, currency string, price_kind string, comparability string, terms string, availability string, observed_at string, seq bigint, product string, variant string",
    "audit": "listing string, event_key string, prior_product string, prior_variant string, new_product string, new_variant string, reason string, authority string, seq bigint, changed_at string",
}


def tables(entities: DataFrame) -> dict[str, DataFrame]:
    """One typed table for each kind of entity."""
    return {k: entities.where(F.col("kind") == k).select(F.from_json("doc", SCHEMAS[k]).alias("d")).select("d.*") for k in KINDS}
