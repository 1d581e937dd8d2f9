"""Product codes: canonical form, validity, evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import squeeze

#: Identifier evidence.
EVIDENCE = "struct<ns:string,raw:string,canonical:string,scope:string,validity:string,source_field:string>"


def gtin_canonical(c: Column) -> Column:
    """8, or 11 to 14, digits padded to 14; null otherwise. A wrong check digit does not void a code."""
    digits = F.trim(c)
    return F.when(digits.rlike(r"^(\d{8}|\d{11,14})$"), F.lpad(digits, 14, "0"))


def gtin_checksum_ok(c: Column) -> Column:
    """Whether the last digit completes the weighted sum of the first 13 to a multiple of ten; false for malformed codes."""
    code = gtin_canonical(c)
    total = sum((F.substring(code, i + 1, 1).cast("int") * (1 if i % 2 else 3) for i in range(13)), F.lit(0))
    return F.coalesce((10 - total % 10) % 10 == F.substring(code, 14, 1).cast("int"), F.lit(False))


def gtin_validity(c: Column) -> Column:
    blank = c.isNull() | (F.trim(c) == "")
    return F.when(blank, "missing").when(gtin_canonical(c).isNull(), "malformed").when(gtin_checksum_ok(c), "valid").otherwise("checksum_invalid")


def from_code(code: Column) -> Column:
    """Evidence of a code ``(ns, raw, scope, field)`` as its source gives it; a missing scope takes the kind's default."""
    ns, raw = code["ns"], code["raw"]
    doubtful = (ns == "mpn") & raw.contains("?")
    default = F.when(ns == "merchant_sku", "merchant_offer").when(ns == "style_code", "style_colorway").otherwise("exact_variant")
    canonical = F.when(ns == "gtin", gtin_canonical(raw)).when(~doubtful, squeeze(raw))
    validity = F.when(ns == "gtin", gtin_validity(raw)).when(doubtful, "malformed").otherwise("valid")
    return F.struct(ns.alias("ns"), raw.alias("raw"), canonical.alias("canonical"), F.coalesce(code["scope"], default).alias("scope"), validity.alias("validity"), code["field"].alias("source_field")).cast(EVIDENCE)


def usable(ids: Column, ns: str) -> Column:
    """Evidence of a kind that has a canonical form and is not malformed; failed check digits stay."""
    return F.filter(ids, lambda i: (i["ns"] == ns) & i["canonical"].isNotNull() & (i["validity"] != "malformed"))


def has_checksum_failure(ids: Column) -> Column:
    return F.exists(ids, lambda i: i["validity"] == "checksum_invalid")


def configurable(ids: Column) -> Column:
    """Whether the merchant's number names a page with several configurations."""
    return F.exists(ids, lambda i: (i["ns"] == "merchant_sku") & (i["scope"] == "configurable_offer"))
