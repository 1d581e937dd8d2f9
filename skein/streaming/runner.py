"""Micro-batches into the log.

Delivery identity never expires, so there is no watermark: a late event is history, not lost. Each micro-batch is an
idempotent append; a batch that runs again after a failure stores nothing twice, so the log is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.engine import Engine
from skein.sources import events as E
from skein.sources import log


def records(stream: DataFrame, source: str, column: str = "value") -> DataFrame:
    """A stream of JSON documents, a record or an event each, as events of one source."""
    v = F.try_parse_json(F.col(column))
    enveloped = E.event_shaped(F.col(column))
    field = lambda c: F.when(enveloped, E.text_at(v, f"$.{c}"))
    defaults = {"operation": "upsert", "null_semantics": "withdraw"}
    own = [F.coalesce(field(c), F.lit(defaults.get(c)).cast("string")).alias(c) for c in E.ENVELOPE]
    return stream.select(F.coalesce(field("source"), F.lit(source)).alias("source"), field("batch_id").alias("batch_id"), *own, F.when(enveloped, F.to_json(E.node_at(v, "$.payload"))).otherwise(F.col(column)).alias("payload"))


def start(events: DataFrame, engine: Engine, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends every micro-batch of ``events`` to the engine's log."""

    def store(batch: DataFrame, number: int) -> None:
        log.append(batch.where("payload is not null"), engine.log_path, engine.adapters)
        engine._catalog = None

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
