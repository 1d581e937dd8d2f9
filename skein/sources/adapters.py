"""Schema adapters: payloads of known shapes to one extraction struct.

An adapter is a predicate and a set of expressions over the parsed payload that say where the raw values are. ``extract``
picks, for every row, the first adapter whose predicate holds, in one projection: a source may mix schemas row by row.
What the values mean is worked out once, after that, for all adapters. A registry is a list; users add their own in front.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import identifiers, money, titles
from skein.functions.text import clean, first_non_blank, plain_number, sku_from_url
from skein.sources.events import has, node_at, number_at, text_at

ATTRIBUTES = f"array<{titles.EVIDENCE}>"
FIELDS = {
    "record_id": "string", "seller": "string", "title": "string", "brand": "string", "condition": "string", "availability": "string", "product_type": "string", "content_origin": "string",
    "source_updated_at": "string", "observed_at": "string", "url": "string", "merchant_sku": "string", "identifiers": f"array<{identifiers.EVIDENCE}>", "attrs": ATTRIBUTES, "nulls": "array<string>", "money": money.EVIDENCE,
}
#: What adapters give: codes and prices as they stand in the payload.
RAW = {k: t for k, t in FIELDS.items() if k not in ("identifiers", "money")} | {
    "title_field": "string", "codes": "array<struct<ns:string,raw:string,scope:string,field:string>>",
    "price": "struct<amount:double,amount_text:string,list_price:double,list_text:string,currency:string,kind:string,hint:string,terms:string,raw:string,field:string>",
}


class Adapter(NamedTuple):
    name: str
    version: str
    supports: Callable[[Column, Column], Column]
    extract: Callable[[Column], dict[str, Column]]


def typed(key: Column, node: Column, field: Column) -> Column:
    """Evidence of one attribute, stated outright, from its JSON node."""
    kind = F.schema_of_variant(node)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    box = kind.rlike("^(OBJECT|ARRAY)")
    text = F.when(box, F.to_json(node)).otherwise(F.try_variant_get(node, "$", "string"))
    value = F.when(number, plain_number(F.try_variant_get(node, "$", "double"))).otherwise(text)
    made = F.struct(key.alias("key"), F.when(number, "number").when(box, "struct").when(kind == "BOOLEAN", "boolean").otherwise("string").alias("kind"), value.alias("value"), text.alias("raw"), field.alias("source_field"), F.lit("explicit").alias("derivation"))
    return F.when(node.isNotNull() & (kind != "VOID"), made.cast(titles.EVIDENCE))


def _entries(node: Column) -> Column:
    """Key and node of an object's fields, nulls left out; empty for anything else."""
    entries = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.coalesce(F.is_variant_null(e["value"]), F.lit(True)))
    return F.coalesce(kept, F.array().cast("array<struct<key:string,value:variant>>"))


def _nulls(node: Column) -> Column:
    """Keys of an object whose value is an explicit null: a patch withdraws these."""
    entries = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    return F.transform(F.filter(entries, lambda e: e["value"].isNull() | F.coalesce(F.is_variant_null(e["value"]), F.lit(True))), lambda e: e["key"])


def _codes(*codes: tuple[str, Column, Column | None, str]) -> Column:
    """Codes as ``(kind, raw, declared scope, field)``."""
    none = F.lit(None).cast("string")
    return F.array(*(F.struct(F.lit(ns).alias("ns"), raw.cast("string").alias("raw"), (none if scope is None else scope).alias("scope"), F.lit(field).alias("field")) for ns, raw, scope, field in codes)).cast(RAW["codes"])


def _price(**parts: Column | str) -> Column:
    names = "amount amount_text list_price list_text currency kind hint terms raw field".split()
    as_column = lambda v: F.lit(v) if v is None or isinstance(v, str) else v
    return F.struct(*(as_column(parts.get(n)).alias(n) for n in names)).cast(RAW["price"])


def _attributes(entries: Column, prefix: str, without: tuple[str, ...] = ("condition",)) -> Column:
    own = F.filter(entries, lambda e: ~e["key"].isin(*without))
    return F.transform(own, lambda e: typed(e["key"], e["value"], F.concat(F.lit(f"{prefix}."), e["key"])))


def _of(entries: Column, key: str) -> Column:
    found = F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(1))
    return F.try_variant_get(found["value"], "$", "string")


def _styles(entries: Column, prefix: str) -> Column:
    own = F.filter(entries, lambda e: (e["key"] == "style_code") & (F.schema_of_variant(e["value"]) == "STRING"))
    return F.transform(own, lambda e: F.struct(F.lit("style_code").alias("ns"), F.try_variant_get(e["value"], "$", "string").alias("raw"), F.lit(None).cast("string").alias("scope"), F.lit(f"{prefix}.style_code").alias("field"))).cast(RAW["codes"])


def _terms(node: Column) -> Column:
    return F.when(F.schema_of_variant(node).startswith("OBJECT"), F.to_json(node))


def _merged(*pairs: tuple[str, Column] | Column) -> Column:
    """JSON objects and (key, JSON value) pairs as one JSON object; null if empty."""
    empty = F.create_map().cast("map<string,variant>")
    maps = [F.coalesce(F.create_map(F.lit(p[0]), p[1]), empty) if isinstance(p, tuple) else F.coalesce(F.try_variant_get(p, "$", "map<string,variant>"), empty) for p in pairs]
    maps = [F.map_filter(m, lambda k, v: v.isNotNull()) for m in maps]
    keys = F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in maps))))
    last = lambda k: F.coalesce(*(F.try_element_at(m, k) for m in reversed(maps)))
    return F.when(F.size(keys) > 0, F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))))


def _json_or_text(text: Column) -> Column:
    """JSON if the text is an object, else the text as a JSON string; null for blank."""
    return F.when(F.length(F.trim(text)) > 0, F.coalesce(F.when(F.trim(text).startswith("{"), F.try_parse_json(text)), text.cast("variant")))


def _csv(p: Column) -> dict[str, Column]:
    at = lambda k: text_at(p, f"$.{k}")
    promo, updated = at("promotion_text"), at("last_updated")
    inner = F.when(F.trim(promo).startswith("{"), F.try_parse_json(promo))
    terms = F.when(inner.isNotNull(), _terms(inner)).otherwise(F.when(F.length(F.trim(promo)) > 0, F.to_json(F.struct(promo.alias("promotion_text")))))
    return {
        "record_id": at("record_id"), "seller": at("merchant"), "title": at("product_name"), "title_field": F.lit("product_name"), "condition": at("condition"), "availability": at("availability"), "product_type": at("product_type"),
        "content_origin": F.nullif(F.trim(at("upstream_origin")), F.lit("")), "source_updated_at": updated, "observed_at": updated, "url": at("deep_link"), "merchant_sku": at("merchant_sku"),
        "codes": _codes(("merchant_sku", at("merchant_sku"), None, "merchant_sku"), ("gtin", at("ean"), None, "ean"), ("mpn", at("manufacturer_part_number"), None, "manufacturer_part_number")),
        "price": _price(amount_text=at("sale_price"), list_text=at("retail_price"), currency=at("currency"), kind=at("price_kind"), hint=at("comparability"), terms=terms, raw=at("sale_price"), field="sale_price"),
    }


def _nested(title: str, fields: dict[str, str], scopes: str | None, sku: Column | str, gtin: str, mpn: str, attributes: str | None, price: dict, price_field: str, terms: Callable[[Column], Column], more: dict[str, str]):
    """Shapes that differ in paths only."""

    def extract(p: Column) -> dict[str, Column]:
        at = lambda path: text_at(p, f"$.{path}")
        scope = lambda ns: at(f"{scopes}.{ns}") if scopes else None
        out = {k: at(path) for k, path in fields.items()}
        number = sku(p) if callable(sku) else at(sku)
        entries = _entries(node_at(p, f"$.{attributes}")) if attributes else F.array().cast("array<struct<key:string,value:variant>>")
        codes = _codes(("merchant_sku", number, scope("merchant_sku"), "page_url" if callable(sku) else sku), ("gtin", at(gtin), scope("gtin"), gtin), ("mpn", at(mpn), scope("mpn"), mpn))
        return out | {
            "title": at(title), "title_field": F.lit(title), "merchant_sku": F.when(F.length(F.trim(number)) > 0, number), "codes": F.concat(codes, _styles(entries, attributes or "")),
            "attrs": _attributes(entries, attributes or ""), "nulls": _nulls(node_at(p, f"$.{attributes}")) if attributes else F.lit(None), "condition": _of(entries, "condition"),
            "price": _price(currency=at(more["currency"]) if "currency" in more else None, kind=at(more["kind"]), hint=at(more["hint"]), terms=terms(p), **{k: f(p) for k, f in price.items()}, field=price_field),
        }

    return extract


_feed = _nested(
    "item.title", {"record_id": "eventId", "seller": "advertiser.name", "product_type": "semantics.productType", "observed_at": "stock.capturedAt", "source_updated_at": "stock.capturedAt", "url": "trackingUrl", "availability": "stock.status"},
    "semantics.identifierScopes", "item.merchantItemId", "item.identifiers.globalTradeItemNumber", "item.identifiers.manufacturerCode", "item.variant",
    {"amount": lambda p: number_at(p, "$.pricing.current"), "list_price": lambda p: number_at(p, "$.pricing.original"), "raw": lambda p: text_at(p, "$.pricing.current")}, "pricing.current", lambda p: _terms(node_at(p, "$.pricing.promotion")),
    {"currency": "pricing.currencyCode", "kind": "semantics.priceKind", "hint": "semantics.comparabilityHint"},
)
_retail = _nested(
    "product.name", {"record_id": "observation_id", "seller": "store.display_name", "brand": "product.brand", "product_type": "semantics.product_type", "content_origin": "semantics.content_origin", "observed_at": "observed_at", "source_updated_at": "observed_at", "url": "product_url", "availability": "offer.availabilityCode"},
    "semantics.identifier_scopes", "sku", "product.barcode", "product.model", "product.specifications",
    {"amount": lambda p: number_at(p, "$.offer.price.amount"), "list_price": lambda p: number_at(p, "$.offer.listPrice"), "raw": lambda p: text_at(p, "$.offer.price.amount")}, "offer.price.amount", lambda p: _terms(node_at(p, "$.offer.terms")),
    {"currency": "offer.price.currency", "kind": "semantics.price_kind", "hint": "semantics.comparability_hint"},
)
_capture = _nested(
    "dom.title", {"record_id": "capture_id", "seller": "merchant", "product_type": "semantic_hints.productType", "content_origin": "content_origin", "observed_at": "observed_at", "source_updated_at": "observed_at", "url": "page_url", "availability": "dom.stockText"},
    "semantic_hints.identifierScopes", lambda p: sku_from_url(text_at(p, "$.page_url")), "partial_identifiers.gtin", "partial_identifiers.mpn", "dom.selectedOptions",
    {"amount_text": lambda p: text_at(p, "$.dom.priceText"), "raw": lambda p: text_at(p, "$.dom.priceText")}, "dom.priceText", lambda p: _terms(node_at(p, "$.offer_context")),
    {"kind": "dom.priceKind", "hint": "semantic_hints.comparability"},
)
_report = _nested(
    "title", {"record_id": "report_id", "seller": "merchant", "product_type": "product_type", "content_origin": "content_origin", "observed_at": "posted_at", "source_updated_at": "posted_at", "url": "url", "availability": "availability_claim"},
    None, "merchant_hint_sku", "partial_identifiers.gtin", "partial_identifiers.mpn", None,
    {"amount": lambda p: number_at(p, "$.reported_price"), "list_price": lambda p: number_at(p, "$.usual_price"), "raw": lambda p: text_at(p, "$.reported_price")}, "reported_price",
    lambda p: _merged(node_at(p, "$.offer_context"), ("requirements", _json_or_text(text_at(p, "$.requirements"))), ("coupon_code", F.when(F.length(F.trim(text_at(p, "$.coupon_code"))) > 0, text_at(p, "$.coupon_code").cast("variant")))),
    {"kind": "price_kind", "hint": "comparability_hint"},
)


def _feed_all(p: Column) -> dict[str, Column]:
    return _feed(p) | {"content_origin": first_non_blank(text_at(p, "$.semantics.contentOrigin"), text_at(p, "$.contentLineage"))}


def _report_all(p: Column) -> dict[str, Column]:
    trust = F.array(F.when(number_at(p, "$.user_confidence").isNotNull(), typed(F.lit("user_confidence"), node_at(p, "$.user_confidence"), F.lit("user_confidence"))))
    return _report(p) | {"attrs": F.filter(trust, lambda x: x.isNotNull())}


def _compact(p: Column) -> dict[str, Column]:
    at = lambda path: text_at(p, f"$.{path}")
    pairs = F.coalesce(F.try_variant_get(p, "$.product.configuration", "array<struct<key:string,value:variant>>"), F.array().cast("array<struct<key:string,value:variant>>"))
    pairs = F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & ~F.coalesce(F.is_variant_null(e["value"]), F.lit(True)))
    gtins = F.filter(_entries(node_at(p, "$.product.identity.codes")), lambda e: F.lower(e["key"]) == "gtin")
    gtins = F.transform(gtins, lambda e: F.struct(F.lit("gtin").alias("ns"), F.try_variant_get(e["value"], "$", "string").alias("raw"), F.lit(None).cast("string").alias("scope"), F.lit("product.identity.codes.gtin").alias("field")))
    return {
        "record_id": at("observation_id"), "seller": at("store.display_name"), "title": first_non_blank(at("product.displayName"), at("product.name")), "title_field": F.lit("product.displayName"), "brand": at("product.identity.brand"),
        "condition": _of(pairs, "condition"), "availability": at("offer.availability"), "product_type": at("semantics.productType"), "content_origin": at("semantics.contentOrigin"), "source_updated_at": at("observed_at"), "observed_at": at("observed_at"),
        "url": at("product_url"), "merchant_sku": at("sku"), "codes": F.concat(_codes(("merchant_sku", at("sku"), None, "sku"), ("mpn", at("product.identity.model"), None, "product.identity.model")), gtins.cast(RAW["codes"])),
        "attrs": F.transform(F.filter(pairs, lambda e: e["key"] != "condition"), lambda e: typed(e["key"], e["value"], F.concat(F.lit("product.configuration["), e["key"], F.lit("]")))),
        "price": _price(amount=number_at(p, "$.offer.money.minorAmount") / 100, list_price=number_at(p, "$.offer.compareAtMinorAmount") / 100, currency=at("offer.money.currency"), kind=at("semantics.priceKind"), terms=_terms(node_at(p, "$.offer.context")), raw=at("offer.money.minorAmount"), field="offer.money.minorAmount"),
    }


def _browser(p: Column) -> dict[str, Column]:
    at = lambda path: text_at(p, f"$.{path}")
    url = first_non_blank(at("url"), at("page_url"))
    is_object = lambda k: F.when(F.schema_of_variant(node_at(p, f"$.{k}")).startswith("OBJECT"), node_at(p, f"$.{k}"))
    meta = _entries(F.coalesce(is_object("metadata"), is_object("attributes")))
    price = first_non_blank(at("price"), at("observed_price"))
    return {
        "record_id": F.lit("resolve-request"), "title": first_non_blank(at("title"), at("page_title")), "title_field": F.lit("title"), "url": url, "brand": _of(meta, "brand"), "condition": _of(meta, "condition"), "merchant_sku": sku_from_url(url),
        "codes": _codes(("merchant_sku", sku_from_url(url), None, "url"), ("mpn", _of(meta, "model"), None, "metadata.model"), ("gtin", at("identifiers.gtin"), None, "identifiers.gtin"), ("mpn", at("identifiers.mpn"), None, "identifiers.mpn")),
        "attrs": _attributes(meta, "metadata", ("brand", "model", "condition")), "price": _price(amount_text=price, raw=price, field="price"),
    }


def _from(source: str, *keys: str):
    def supports(s: Column, p: Column) -> Column:
        out = s == source
        for k in keys:
            out = out & has(p, k)
        return out

    return supports


def registry() -> list[Adapter]:
    """The built-in adapters, more specific fingerprints first."""
    compact = lambda s, p: (s == "retailer_api") & ((text_at(p, "$.schema_version") == "2026-08-compact") | F.schema_of_variant(node_at(p, "$.product.configuration")).startswith("ARRAY"))
    v1 = lambda s, p: (s == "retailer_api") & has(p, "observation_id") & node_at(p, "$.product.specifications").isNotNull()
    return [
        Adapter("retailer_api", "2026-08-compact", compact, _compact), Adapter("retailer_api", "v1", v1, _retail),
        Adapter("affiliate_a", "csv_v1", _from("affiliate_a", "record_id", "product_name"), _csv), Adapter("affiliate_b", "feed_v3.7", _from("affiliate_b", "eventId", "item"), _feed_all),
        Adapter("community_deals", "v1", _from("community_deals", "report_id"), _report_all), Adapter("extension_observations", "0.9.x", _from("extension_observations", "capture_id"), _capture),
        Adapter("browser_resolve", "v1", _from("browser_resolve"), _browser),
    ]


def select(source: Column, payload: Column, adapters: list[Adapter]) -> Column:
    """``name:version`` of the first adapter that supports a parsed payload; null for none."""
    out = F.lit(None).cast("string")
    for a in reversed(adapters):
        out = F.when(F.coalesce(a.supports(source, payload), F.lit(False)), f"{a.name}:{a.version}").otherwise(out)
    return out


def extract(events: DataFrame, adapters: list[Adapter] | None = None) -> DataFrame:
    """Adds ``adapter`` and ``x``, the extraction: all rows keep their place, also those that no adapter supports."""
    adapters = registry() if adapters is None else adapters
    p, r = F.col("__p"), lambda k: F.col(f"__r.{k}")
    out = events.withColumn("__p", F.try_parse_json("payload")).withColumn("adapter", select(F.col("source"), p, adapters))
    raw = F.lit(None).cast("struct<" + ",".join(f"{k}:{t}" for k, t in RAW.items()) + ">")
    for a in adapters:
        got = a.extract(p)
        own = F.struct(*(got.get(k, F.lit(None)).cast(t).alias(k) for k, t in RAW.items()))
        raw = F.when(F.col("adapter") == f"{a.name}:{a.version}", own).otherwise(raw)
    out = out.withColumn("__r", raw).withColumn("__title", clean(r("title")))
    codes = F.transform(F.filter(r("codes"), lambda c: F.length(F.trim(c["raw"])) > 0), identifiers.from_code)
    empty = F.array().cast(ATTRIBUTES)
    amount = F.coalesce(r("price.amount"), money.parse_money(r("price.amount_text")))
    price = money.evidence(amount, F.coalesce(r("price.list_price"), money.parse_money(r("price.list_text"))), r("price.currency"), r("price.kind"), r("price.hint"), r("price.terms"), r("availability"), r("observed_at"), r("price.raw"), r("price.field"))
    made = {
        "title": F.col("__title"), "condition": F.coalesce(r("condition"), F.lit("new")), "product_type": F.coalesce(r("product_type"), F.lit("primary_product")), "identifiers": codes,
        "attrs": F.concat(F.coalesce(r("attrs"), empty), titles.title_attributes(F.col("__title"), r("title_field"), cleaned=True)), "money": price,
    }
    x = F.struct(*(made.get(k, r(k) if k in RAW else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()))
    return out.withColumn("x", F.when(F.col("adapter").isNotNull(), x)).drop("__p", "__r", "__title")
