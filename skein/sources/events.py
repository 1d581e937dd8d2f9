"""Transports and envelopes: from files and JSON documents to rows of the event log's shape.

An event is ``source, batch_id, operation, update_mode, event_id, idempotency_key, corrects_listing_id,
source_updated_at, received_at, null_semantics, payload`` (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys under which a document may hold its records, in order; envelope fields.
HOLDERS = "records events items products deals observations".split()
ENVELOPE = "operation update_mode event_id idempotency_key corrects_listing_id source_updated_at received_at null_semantics".split()
COLUMNS = ["source", "batch_id", *ENVELOPE, "payload"]


def text_at(v: Column, path: str) -> Column:
    """A scalar at a JSON path as text; null for containers, JSON null and what is not there."""
    node = F.try_variant_get(v, path, "variant")
    return F.when(~F.schema_of_variant(node).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, path, "string"))


def node_at(v: Column, path: str) -> Column:
    """A node at a JSON path; null for JSON null."""
    node = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(node), node)


def number_at(v: Column, path: str) -> Column:
    """A JSON number at a path as double; texts and containers are no numbers."""
    node = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(node).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, path, "double"))


def has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def unwrap(docs: DataFrame, column: str = "value") -> DataFrame:
    """One row ``record`` (JSON text) and ``ord`` for each element of the first array that a document holds.

    A document that does not parse, or holds no array, has no records.
    """
    v = F.try_parse_json(F.col(column))
    array = lambda node: F.when(F.schema_of_variant(node).startswith("ARRAY"), F.try_variant_get(node, "$", "array<variant>"))
    found = F.coalesce(*(array(F.try_variant_get(v, f"$.{k}", "variant")) for k in HOLDERS), array(v))
    rest = [c for c in docs.columns if c != column]
    return docs.select(*rest, F.posexplode(found).alias("ord", "__r")).withColumn("record", F.to_json("__r")).drop("__r")


def event_shaped(record: Column) -> Column:
    """Whether a record is an event with its own envelope."""
    v = F.try_parse_json(record)
    return has(v, "payload") & (has(v, "event_id") | has(v, "operation"))


def from_records(records: DataFrame, source: str, batch_id: str | None = None, **envelope: str | None) -> DataFrame:
    """Events of plain records under one request envelope; ``records(record)``."""
    given = {"operation": "upsert", "null_semantics": "withdraw"} | envelope
    lit = lambda x: F.lit(x).cast("string")
    return records.select(lit(source).alias("source"), lit(batch_id).alias("batch_id"), *(lit(given.get(c)).alias(c) for c in ENVELOPE), F.col("record").alias("payload"))


def from_events(events: DataFrame, batch_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events that carry their envelope, and the rejected ones, which have no payload; ``events(record)``."""
    v = F.try_parse_json(F.col("record"))
    default = {"operation": "upsert", "null_semantics": "withdraw"}
    fields = [F.coalesce(text_at(v, f"$.{c}"), F.lit(default.get(c)).cast("string")).alias(c) for c in ENVELOPE]
    decoded = events.select(text_at(v, "$.source").alias("source"), F.coalesce(text_at(v, "$.batch_id"), F.lit(batch_id).cast("string")).alias("batch_id"), *fields, F.to_json(node_at(v, "$.payload")).alias("payload"), "record")
    return decoded.where("payload is not null").select(COLUMNS), decoded.where("payload is null").select("record")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted commas and doubled quotes; every value a string. ``record`` is the row as JSON."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", False)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.select(F.to_json(F.struct(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))).alias("record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents, a document a file."""
    return unwrap(spark.read.text(path, wholetext=True))


def effective_mode(operation: Column, update_mode: Column) -> Column:
    """The declared update mode, else the one that the operation means."""
    of = F.when(operation == "correct", "authoritative_correction").when(operation.isin("unavailable", "delete"), "listing_tombstone").when(operation == "patch", "partial_patch").otherwise("full_snapshot")
    return F.when(F.length(F.trim(update_mode)) > 0, update_mode).otherwise(of)
