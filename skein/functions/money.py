"""Prices: parsing, evidence, comparability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import clean

# What counts as an amount, and the defaults of price evidence.
AMOUNT = r"^(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?)$"
CURRENCY, TOTAL = "USD", "total_purchase_price"
EVIDENCE = (
    "struct<amount:double,list_price:double,currency:string,price_kind:string,comparability:string,terms:string,"
    "availability:string,observed_at:string,validity:string,raw:string,source_field:string>"
)


def parse_money(c: Column) -> Column:
    """The amount of a text that is nothing but an amount and a dollar sign or code; null otherwise, never a guess."""
    text = F.trim(F.replace(F.replace(clean(c), F.lit("$"), F.lit("")), F.lit("USD"), F.lit("")))
    return F.when(text.rlike(AMOUNT), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def evidence(amount: Column, list_price: Column, currency: Column, kind: Column, hint: Column, terms: Column, availability: Column, observed_at: Column, raw: Column, field: Column) -> Column:
    """Price evidence; a raw price without an amount is invalid. ``terms`` is JSON text, null for none."""
    none = F.coalesce(terms.isin("{}", ""), F.lit(True))
    values = {
        "amount": amount, "list_price": list_price, "currency": F.coalesce(currency, F.lit(CURRENCY)), "price_kind": F.coalesce(kind, F.lit(TOTAL)), "comparability": hint,
        "terms": F.when(~none, terms), "availability": availability, "observed_at": observed_at,
        "validity": F.when(amount.isNull() & (F.length(F.trim(raw)) > 0), "invalid").otherwise("valid"), "raw": raw, "source_field": field,
    }
    return F.struct(*(v.alias(k) for k, v in values.items())).cast(EVIDENCE)


def comparability(hint: Column, amount: Column, kind: Column, terms: Column, condition: Column) -> Column:
    """A source's hint first; then by amount, kind, terms and condition. Conditional prices are never comparable outright."""
    return (
        F.when(F.length(F.trim(hint)) > 0, F.upper(hint)).when(amount.isNull(), "UNKNOWN").when(~kind.eqNullSafe(F.lit(TOTAL)), "NOT_COMPARABLE")
        .when(terms.isNotNull() & ~terms.isin("", "{}"), "CONDITIONAL").when(F.lower(F.coalesce(condition, F.lit("new"))) != "new", "NOT_COMPARABLE").otherwise("COMPARABLE")
    )
