"""Identity policy: which attributes are product, variant and price-critical dimensions, by category."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimensions by category: product; variant; price-critical.
CATEGORIES = {
    "phones": ("brand model generation", "storage_gb color carrier", "storage_gb carrier"),
    "laptops": ("brand model processor_generation", "screen_in ram_gb storage_gb color gpu", "processor_generation ram_gb storage_gb gpu screen_in"),
    "smartwatches": ("brand model generation", "case_size_mm connectivity case_material color bundle", "case_size_mm connectivity case_material"),
    "storage_devices": ("brand model generation", "capacity_gb interface form_factor heatsink bundle", "capacity_gb interface heatsink"),
    "cameras": ("brand model generation", "sensor_format included_lens warranty_region bundle", "included_lens warranty_region bundle"),
    "game_consoles": ("brand model generation", "edition storage_gb bundle", "edition storage_gb bundle"),
    "footwear": ("brand style_code generation", "department size_us width color bundle", "size_us width bundle"),
    "beauty_and_fragrance": ("brand line formulation_family", "volume_ml formulation strength_pct bundle", "volume_ml formulation strength_pct bundle"),
    "tires": ("brand model season", "width_mm aspect_ratio rim_in load_index speed_rating extra_load run_flat quantity", "width_mm aspect_ratio rim_in load_index speed_rating run_flat quantity"),
    "power_tools": ("brand model voltage_platform tool_type", "voltage_v battery_count battery_capacity_ah charger_included bundle", "voltage_v battery_count battery_capacity_ah charger_included bundle"),
    "printer_supplies": ("brand model compatible_printer_family", "color yield_pages yield_class oem_status cartridge_count bundle", "color yield_pages oem_status cartridge_count"),
    "books_media": ("work edition language", "format edition language region disc_count license bundle", "format edition language region license"),
    "networking": ("brand model wifi_generation", "band_count max_speed_mbps ethernet_ports poe node_count region bundle", "max_speed_mbps ethernet_ports poe node_count region"),
}
DEFAULT, ALWAYS = "__default__", "color size department bundle case_connector".split()


class Policy(NamedTuple):
    product: list[str]
    variant: list[str]
    critical: list[str]

    @property
    def dims(self) -> list[str]:
        """What a listing must agree on to share a variant, in order."""
        return list(dict.fromkeys([*self.variant, *self.critical]))


def with_default(categories: dict[str, Policy]) -> dict[str, Policy]:
    every = list(dict.fromkeys([*(d for p in categories.values() for d in p.variant), *ALWAYS]))
    return categories | {DEFAULT: Policy(["brand", "model", "generation"], every, every)}


def built_in() -> dict[str, Policy]:
    return with_default({c: Policy(*(d.split() for d in dims)) for c, dims in CATEGORIES.items()})


def load(spark: SparkSession, path: str) -> dict[str, Policy]:
    """From a JSON document with ``categories``; read through Spark, so from any store. A policy is small by nature."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return with_default({c: Policy(*(v.get(f"{k}_dimensions", []) for k in ("product", "variant", "price_critical"))) for c, v in doc["categories"].items()})


def table(spark: SparkSession, policies: dict[str, Policy]) -> DataFrame:
    """``category, role, dim, ord``."""
    rows = [(c, role, d, i) for c, p in policies.items() for role, dims in zip(("product", "variant", "price_critical"), p, strict=True) for i, d in enumerate(dims)]
    return spark.createDataFrame(rows, "category string, role string, dim string, ord int")


def dims_of(category: Column, policies: dict[str, Policy]) -> Column:
    """The dimensions of a category, of the default policy for one that is not listed."""
    out = F.array(*map(F.lit, policies[DEFAULT].dims))
    for name, p in policies.items():
        if name != DEFAULT:
            out = F.when(category == name, F.array(*map(F.lit, p.dims))).otherwise(out)
    return out


def canonical_keys(policies: dict[str, Policy]) -> list[str]:
    """Attribute keys that may be state; others are kept as unknown attributes. Not case_connector, which no category has."""
    named = [d for c, p in policies.items() if c != DEFAULT for d in (*p.product, *p.variant, *p.critical)]
    return list(dict.fromkeys([*named, "size"]))


# Rules in their order: any of these attributes, or all of those; or any of these words in the title;
# unless this word is there; the category. A rule marked with "and" needs attributes and words.
RULES = [
    ("capacity_gb", "interface form_factor", "", "", "storage_devices"),
    ("case_size_mm case_material", "", "smartwatch", "", "smartwatches"),
    ("formulation volume_ml", "", "", "", "beauty_and_fragrance"),
    ("size_us", "", "running shoe|road shoe", "", "footwear"),
    ("and edition", "", "console|novaplay", "", "game_consoles"),
    ("ram_gb", "", "laptop|airbook|air book", "", "laptops"),
    ("carrier", "", "phone", "headphone", "phones"),
    ("", "", "headphone|earbud|airbud|buds", "", "headphones"),
    ("", "", "console|novaplay", "", "game_consoles"),
    ("", "", "television| tv|qled", "", "tvs"),
    ("", "", "vacuum", "", "vacuums"),
    ("", "", "blender", "", "small_appliances"),
    ("", "", "tee|jacket|crew|shirt", "", "apparel"),
    ("", "", "serum|parfum|fragrance|toilette", "", "beauty_and_fragrance"),
    ("", "", "ssd|solid state|nvme|internal drive", "", "storage_devices"),
    ("", "", "watch", "", "smartwatches"),
]


def infer_category(keys: Column, title: Column) -> Column:
    """From the attributes that are there, then from words in the title; the first rule that holds."""
    t = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit("unknown")
    for some, every, words, without, name in reversed(RULES):
        strict, some = some.startswith("and "), some.removeprefix("and ").split()
        attrs = F.arrays_overlap(keys, F.array(*map(F.lit, some))) if some else F.lit(False)
        for group in filter(None, [every.split()]):
            attrs = attrs | (F.size(F.array_intersect(keys, F.array(*map(F.lit, group)))) == len(group))
        says = t.rlike(words) if words else F.lit(False)
        holds = (attrs & says) if strict else (attrs | says)
        out = F.when(holds & ~t.contains(without) if without else holds, name).otherwise(out)
    return out


def inferred(keys: set[str], title: str | None) -> str:
    """The same rules for one listing of the ordered fold."""
    t = (title or "").lower()
    for some, every, words, without, name in RULES:
        strict, some = some.startswith("and "), set(some.removeprefix("and ").split())
        attrs = bool(some & keys) or (bool(every) and set(every.split()) <= keys)
        says = bool(words) and any(w in t for w in words.split("|"))
        if ((attrs and says) if strict else (attrs or says)) and not (without and without in t):
            return name
    return "unknown"
