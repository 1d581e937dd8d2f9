"""The decision ladder: two tables of rules from what is known of a listing's candidates to a decision.

The ordered fold and read-only resolution decide by the same tables. A condition uses only comparisons and ``&`` over named
facts, so it reads Python values and columns alike; the first rule that holds decides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    holds: Callable[[Any], Any]
    #: MATCH, REVIEW or NO_MATCH; of a product's rule, none where the variant is looked for next.
    decision: str | None = "REVIEW"
    confidence: float = 0.5
    #: What is taken, or which candidates are hypotheses, and their score; none is an equal share of 1.
    takes: str | None = None
    guesses: str | None = None
    score: float | None = 0.5
    #: A negative signal: its field and what it says.
    field: str | None = None
    note: str | None = None


#: Facts: ``best`` products in the strongest stratum ``top`` that category and generation allow; whether the only one is reached by a
#: ``copied`` code; whether they are ``mergeable``; how many of several weak ones have a ``shared`` code; whether one is ``creatable``; ``candidates`` in all.
PRODUCT = (
    Rule("copied code", lambda f: (f.best == 1) & f.copied, guesses="best", field="identifier", note="the code's product has another model family: a copied code"),
    Rule("one product", lambda f: f.best == 1, None, takes="best"),
    Rule("one family", lambda f: (f.best > 1) & (f.top >= 2) & f.mergeable, None, takes="all"),
    Rule("products differ", lambda f: (f.best > 1) & (f.top >= 2), guesses="best", field="identity", note="strong evidence for products that differ"),
    Rule("one shares a code", lambda f: (f.best > 1) & (f.shared == 1), None, takes="shared"),
    Rule("weak tie", lambda f: f.best > 1, guesses="best", score=0.4),
    Rule("new product", lambda f: f.creatable, None, takes="new"),
    Rule("unknown", lambda f: f.candidates == 0, "NO_MATCH", 0.2),
    Rule("dropped", lambda f: f.always, confidence=0.4, guesses="scored", score=0.3),
)
#: Facts of the product's variants: whether the listing is ``secondary`` to it; its ``doubtful`` dimensions; ``pins``, variants that a code names,
#: and how many of them are ``fitting``; ``viable`` ones, which have all the listing's dimensions; whether one is ``creatable``.
VARIANT = (
    Rule("secondary", lambda f: f.secondary, guesses="product", score=0.4, field="product_type", note="not a primary product"),
    Rule("doubtful", lambda f: f.doubtful > 0, guesses="undoubted"),
    Rule("shared code", lambda f: (f.pins > 1) & (f.fitting != 1), guesses="pins", field="identifier", note="a code is shared by several variants"),
    Rule("pinned", lambda f: f.fitting == 1, "MATCH", 0.95, takes="pin"),
    Rule("pin differs", lambda f: (f.pins == 1) & (f.viable > 1), guesses="pins and viable", field="identifier", note="the code's variant has other attributes"),
    Rule("several", lambda f: f.viable > 1, guesses="viable", score=None, field="variant", note="several variants fit"),
    Rule("fits", lambda f: f.viable == 1, "MATCH", 0.9, takes="viable"),
    Rule("new variant", lambda f: f.creatable, "MATCH", 0.9, takes="new"),
    Rule("pin alone", lambda f: f.pins == 1, guesses="pins", field="identifier", note="the code's variant has other attributes"),
    Rule("no variant", lambda f: f.always, guesses="variants", score=0.4),
)


def first(rules: Sequence[Rule], facts: Any) -> Rule:
    """The rule that decides, for Python values."""
    return next(r for r in rules if r.holds(facts))


def named(rules: Sequence[Rule], facts: Any) -> Column:
    """The name of the rule that decides, for columns."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.holds(facts), r.name).otherwise(out)
    return out


def of(rules: Sequence[Rule], rule: Column, what: str, kind: str) -> Column:
    """A field of the rule that a column names; a lookup, so that the column's expression is not repeated."""
    known = [(r.name, getattr(r, what)) for r in rules if getattr(r, what) is not None]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known for x in pair)), rule).cast(kind)
