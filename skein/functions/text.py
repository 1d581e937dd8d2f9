"""Text normalisation and model tokens, as column expressions.

Everything stays in the JVM: the only regular expression engine is Spark's own. Word lists and patterns are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these characters, words and patterns.
TAG = "<[^>]{1,80}>"
DROPPED = "​‎‏"
DASHES = "‑–—"
CODE = r"\b([A-Za-z]{1,8}-?\d{1,4}[A-Za-z0-9]*(?:-[A-Za-z0-9]{1,6})*)\b"
WORD_NUMBER = r"\b([A-Za-z]{3,15})[\s-](\d{1,4})\b(?!\s?(?i:mm|gb|tb|ml|oz|in\b|inch|\"|percent|%|pack|x\b|fl))"
FAMILY = r"^([A-Za-z]{1,8})-?(\d{1,4})"
STOP = """
inch gb tb ml oz mm us ram pack size months month fl the with for and pcs gen usb type series qled edp edt no
unlocked phone black white silver midnight plus includes gift card payments save only total free up to x nvme pcie m lot
pay members one two three four five six seven eight nine ten set case
""".split()
SPEC_TOKENS = """
M2 M22280 PCIE4 PCIE3 PCIE5 USB2 USB3 USBC WIFI5 WIFI6 WIFI7 TYPE1 TYPE2 GEN1 GEN2 GEN3 DDR4 DDR5
""".split()
GENERIC_HEAD = """
solid state drive internal wireless premium professional cordless countertop stick road running waterproof everyday
quantum noise canceling last previous weekend special new with the and for plus best top
""".split()

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def first_non_blank(*cols: Column) -> Column:
    """The first value that is neither null nor blank, as it is."""
    return F.coalesce(*(F.when(F.length(F.trim(c)) > 0, c) for c in cols))


def clean(c: Column) -> Column:
    """Tags and odd blanks to blanks, invisible marks away, dashes and full-width characters to ASCII, blanks collapsed."""
    plain = F.translate(F.regexp_replace(c, TAG, " "), " " + DASHES + _WIDE + DROPPED, " " + "-" * len(DASHES) + _ASCII)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def squeeze(c: Column) -> Column:
    """Letters and digits only, upper-cased; null if none."""
    return F.nullif(F.upper(F.regexp_replace(clean(c), "[^A-Za-z0-9]", "")), F.lit(""))


def family(token: Column) -> Column:
    """Leading letters and the digits that follow; null for interface and form-factor codes."""
    found = F.upper(F.concat(F.regexp_extract(token, FAMILY, 1), F.regexp_extract(token, FAMILY, 2)))
    return F.when((found != "") & ~found.isin(SPEC_TOKENS), found)


def _codes(text: Column) -> Column:
    """Code-shaped tokens of a clean text whose letters are no stop word."""
    head = lambda t: F.lower(F.regexp_replace(t, r"[-\d].*", ""))
    return F.filter(F.regexp_extract_all(text, F.lit(CODE), F.lit(1)), lambda t: ~head(t).isin(STOP))


def _present(array: Column) -> Column:
    return F.array_distinct(F.filter(array, lambda x: x.isNotNull()))


def family_tokens(c: Column) -> Column:
    """Model-family tokens of a free text, in order and once each; empty for null."""
    text = clean(c)
    from_codes = F.filter(F.transform(_codes(text), family), lambda f: (F.length(f) >= 2) & ~F.lower(f).isin(STOP))
    pairs = F.regexp_extract_all(text, F.lit(WORD_NUMBER), F.lit(0))
    word = lambda p: F.lower(F.regexp_extract(p, "^[A-Za-z]+", 0))
    from_words = F.transform(F.filter(pairs, lambda p: ~word(p).isin(STOP)), lambda p: F.upper(F.regexp_replace(p, r"[\s-]", "")))
    return F.coalesce(_present(F.concat(from_codes, from_words)), F.array().cast("array<string>"))


def full_codes(c: Column) -> Column:
    """Whole squeezed codes of at least three characters."""
    squeezed = F.transform(_codes(clean(c)), squeeze)
    return F.coalesce(_present(F.filter(squeezed, lambda s: F.length(s) >= 3)), F.array().cast("array<string>"))


def fallback_tokens(title: Column, brand: Column) -> Column:
    """The squeezed brand, and the title's first word that is neither generic nor a stop word; for texts without codes."""
    words = F.regexp_extract_all(clean(title), F.lit(r"([A-Za-z][A-Za-z\-]{2,})"), F.lit(1))
    head = F.try_element_at(F.filter(words, lambda w: ~F.lower(w).isin(GENERIC_HEAD + STOP)), F.lit(1))
    both = F.array(squeeze(brand), squeeze(head))
    return _present(F.filter(both, lambda s: F.length(s) >= 3))


def sku_from_url(url: Column) -> Column:
    """Last segment of the path; null for no path and for what is no URL."""
    path = F.regexp_replace(F.try_parse_url(F.trim(url), F.lit("PATH")), "/+$", "")
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def sha16(c: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the text."""
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys; null if it does not parse."""
    return F.to_json(F.try_parse_json(c))


def plain_number(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    d = c.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def canonical_value(key: Column, value: Column) -> Column:
    """Colours are trimmed, lower-cased and aliased; other texts also get underscores for blanks."""
    low = F.lower(F.trim(value))
    return F.when(key == "color", F.when(low == "blk", "black").otherwise(low)).otherwise(F.replace(low, F.lit(" "), F.lit("_")))
