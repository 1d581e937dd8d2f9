"""Secret scans: the rules' combined automaton over whole texts.

Each rule is an expression and a least length of a match or of a part of it; matches that are shorter are dropped after
the leftmost non-overlapping ones have been found. Documents are scanned where they are read: no shuffle, and memory
for one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.automaton import Scanner
from skein.llm.common import of_worker, with_text


class Rule(NamedTuple):
    kind: str
    pattern: bytes
    #: Group of which the length counts, and the least length.
    group: int
    least: int


#: The base rules. The counted repeats drop the same matches as the least lengths would.
ASSIGN = rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 2, 8), Rule("access", rb"AKIA[A-Z0-9]{12,}", 0, 16), Rule("hex", rb"[0-9a-f]{32,}", 0, 32))
MORE = (
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + MORE


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner([r.pattern for r in rules])


def spans(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then as the rules are listed."""
    kept = []
    for k, start, end in scanner(rules).matches(data):
        m = re.fullmatch(rules[k].pattern, data[start:end])
        if len(m[rules[k].group]) >= rules[k].least:
            kept.append((start, k, end))
    kept.sort()
    if not kept or data.isascii():
        return [(rules[k].kind, a, b) for a, k, b in kept]
    at, points, of = 0, 0, {}
    for p in sorted({x for a, _, b in kept for x in (a, b)}):
        points += len(data[at:p].decode())
        at, of[p] = p, points
    return [(rules[k].kind, of[a], of[b]) for a, k, b in kept]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns and ``spans array<struct<kind, start, end>>``: code points, end exclusive, by start and rule.

    A null or empty text has no spans. Every row of docs gives one row, repeated ones too; an empty table none. Columns
    of docs that are not kept are not read; a kept one of the name spans is replaced. Equal starts go by the rules' order.
    """
    keep = [c for c in keep if c.lower() != "spans"]
    schema = docs.select(*keep, F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)").alias("spans")).schema
    sent, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_worker()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py() or b"", rules)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(SPAN))], names=[*keep, "spans"])

    return sent.mapInArrow(run, schema)


def masked(text: Column, spans_: Column, label: str = "<secret>") -> Column:
    """The text with each maximal run of overlapping or touching spans replaced by the label."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] > acc["at"]
        begun = (acc["at"] > 0) & ~gap
        piece = F.when(gap, F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).otherwise(F.lit(""))
        out = F.concat(acc["out"], piece, F.when(begun & (s["start"] <= acc["at"]), F.lit("")).otherwise(F.lit(label)))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans_) == 0, text).otherwise(F.aggregate(spans_, zero, step, rest))


def _listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
