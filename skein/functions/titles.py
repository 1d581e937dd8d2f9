"""Attributes that a title states, as an array of evidence.

Each attribute is one expression over the clean title; an absent one is null and filtered out, so a title is read by
projections alone. Patterns and phrases are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import clean, plain_number

#: Attribute evidence.
EVIDENCE = "struct<key:string,kind:string,value:string,raw:string,source_field:string,derivation:string>"

# Colours; the alias is applied with the value.
COLOURS = ["black", "blk", "blue", "gold", "gray", "green", "grey", "midnight", "natural", "ocean blue", "pink", "red", "silver", "starlight", "ultramarine", "white"]
# Phrases that name what is in the box, the value they give, and the words that are kept.
BUNDLES = [
    ("single pair", "single_pair", "single pair"), ("standard tools", "standard_tools", "standard tools"), ("watch only", "watch_only", "watch only"), ("drive only", "drive_only", "drive only"),
    ("standard pitcher", "standard_pitcher", "standard pitcher"), ("gift set", "gift_set", "gift set"), ("set with travel", "gift_set", "gift set"),
]


def attribute(key: str, value: Column, raw: Column, field: Column, kind: str = "string", derivation: Column | str = "normalized") -> Column:
    derivation = F.lit(derivation) if isinstance(derivation, str) else derivation
    made = F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), value.alias("value"), raw.alias("raw"), field.alias("source_field"), derivation.alias("derivation"))
    return F.when(value.isNotNull() & (value != ""), made.cast(EVIDENCE))


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")


def colour(low: Column) -> Column:
    """The longest colour named; of equal lengths the one named first."""
    named = F.regexp_extract_all(low, F.lit(rf"\b({'|'.join(COLOURS)})\b"), F.lit(1))
    longest = F.array_min(F.transform(named, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("at"), c.alias("c"))))
    return F.when(low.contains("black/white") | low.contains("black white"), "black/white").otherwise(longest["c"])


def storage_gb(text: Column) -> tuple[Column, Column]:
    """The largest number of gigabytes that is not memory, and its words; 1024 and 2048 count as 1000 and 2000."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b\d{2,4}\s?gb\b(?!\s?ram)"), F.lit(0))
    most = F.array_max(F.transform(found, lambda m, i: F.struct(F.regexp_extract(m, r"\d+", 0).cast("int").alias("n"), (-i).alias("at"), m.alias("m"))))
    return F.when(most["n"] > 0, F.when(most["n"] == 1024, 1000).when(most["n"] == 2048, 2000).otherwise(most["n"])).cast("double"), most["m"]


def volume_ml(text: Column) -> tuple[Column, Column, Column]:
    """Millilitres, or fluid ounces taken to the usual size near by; the words; and how it was derived."""
    metric, ounces = r"\b(\d{1,4})\s?m[lL]\b", r"(?i)\b(\d(?:\.\d)?)\s?fl\s?oz\b"
    ml, oz = _number(text, metric), _number(text, ounces) * 29.5735
    near = F.when(F.abs(oz - 30) < 2, 30.0).when(F.abs(oz - 50) < 2, 50.0).when(F.abs(oz - 100) < 3, 100.0).otherwise(F.round(oz))
    either = lambda a, b: F.when(ml.isNotNull(), a).otherwise(b)
    return F.coalesce(ml, near), either(F.regexp_extract(text, metric, 0), F.regexp_extract(text, ounces, 0)), either(F.lit("normalized"), F.lit("inferred"))


def title_attributes(title: Column, field: Column, cleaned: bool = False) -> Column:
    """All attributes of a title; empty for null. ``cleaned`` says that it is clean already."""
    return F.coalesce(F.filter(slots(title, field, cleaned), lambda a: a.isNotNull()), F.array().cast(f"array<{EVIDENCE}>"))


def slots(title: Column, field: Column, cleaned: bool = False) -> Column:
    """An array of every attribute that a title may state, null where it does not."""
    text = title if cleaned else clean(title)
    low = F.lower(text)
    word = lambda pattern: low.rlike(rf"\b({pattern})\b")
    number = lambda key, pattern, times=1: attribute(key, plain_number(_number(text, pattern) * times), F.regexp_extract(text, pattern, 0), field, "number")
    named = lambda key, value, raw: attribute(key, value, raw, field)
    first = lambda *cases: [reduce(lambda out, c: F.when(c[0], c[i]).otherwise(out), reversed(cases), F.lit(None).cast("string")) for i in (1, 2)]
    (gb, gb_words), (ml, ml_words, derived) = storage_gb(text), volume_ml(text)
    colour_ = colour(low)
    us, packs = r"(?i)\bus\s?(\d{1,2}(?:\.5)?)\b", F.regexp_extract(text, r"(?i)\b(\d)\s?[-\s]?pack\b|\b(\d)\s?x\b", 0)
    return F.array(
        named("color", F.when(colour_ == "blk", "black").otherwise(colour_), colour_),
        attribute("storage_gb", plain_number(gb), gb_words, field, "number"),
        number("storage_gb", r"(?i)\b(\d{1,2})\s?tb\b", 1000),
        attribute("volume_ml", plain_number(ml), ml_words, field, "number", derived),
        named("size_us", F.regexp_extract(text, us, 1), F.regexp_extract(text, us, 0)),
        named("size", *first((word("medium"), "M", "medium"), (word("large") & ~low.contains("x-large"), "L", "large"), (word("small"), "S", "small"))),
        named("department", *first((word("men's|mens"), "mens", "men's"), (word("women's|womens"), "womens", "women's"))),
        number("screen_in", r"(?i)\b(\d{2}(?:\.\d)?)[\s-]?(?:inch|in\b|\")"),
        number("screen_in", r"(?i)\b(1[0-7](?:\.\d)?)[\s-]?(?:inch|in\b)"),
        number("case_size_mm", r"(?i)\b(\d{2})\s?mm\b"),
        number("ram_gb", r"(?i)\b(\d{1,2})\s?gb\s?ram\b"),
        named("bundle", F.when(packs != "", F.concat(F.regexp_extract(packs, r"\d", 0), F.lit("_pack"))), packs),
        named("bundle", *first(*((low.contains(phrase), value, raw) for phrase, value, raw in BUNDLES))),
        named("edition", *first((low.contains("digital"), "digital", "digital"), (low.contains("disc") | low.contains("optical drive"), "disc", "disc/optical"))),
        number("generation", r"\b(20\d{2})\b"),
        named("formulation", *first((low.contains("eau de parfum") | word("edp"), "eau_de_parfum", "eau de parfum"), (low.contains("eau de toilette") | word("edt"), "eau_de_toilette", "eau de toilette"))),
    )
