"""The durable event log: delivery identity, deduplication, idempotent appends.

A delivery is ``(event_key, payload_hash)``: the key is scoped to the record, so the shared id of a batch never suppresses
its siblings. The first payload of a key wins; the same payload again is a duplicate, another one a conflict, which is
quarantined and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import canonical_json, sha16
from skein.operators.graph import checkpointed, spread
from skein.sources.adapters import Adapter, extract
from skein.sources.events import COLUMNS

# Names of fields that hold a record's id, without separators and case.
ID_KEYS = {"recordid", "eventid", "observationid", "reportid", "captureid", "sourcerecordid", "listingid", "id"}


def sniffed(payload: str | None) -> str | None:
    """The record id of a payload of unknown shape: a scalar field of a known name, outermost and first; arrays are not searched."""
    try:
        level = [json.loads(payload)] if payload else []
    except ValueError:
        return None

    def of(node: object) -> str | None:
        if not isinstance(node, dict):
            return None
        for k, v in node.items():
            if k.lower().replace("_", "").replace("-", "") in ID_KEYS and isinstance(v, (str, int, float)) and str(v).strip():
                return str(v).lower() if isinstance(v, bool) else str(v)
        return next(filter(None, map(of, node.values())), None)

    return of(level[0]) if level else None


def _sniff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"payload": f["payload"], "sniffed": f["payload"].map(sniffed)})


def payload_hash(payload: Column) -> Column:
    """Of the JSON with sorted keys; of the text itself where it is no JSON."""
    return sha16(F.coalesce(canonical_json(payload), payload))


def event_key(source: Column, event_id: Column, batch_id: Column, record_id: Column, hash_: Column) -> Column:
    scope = F.coalesce(F.when(F.length(F.trim(event_id)) > 0, event_id), batch_id, F.lit("batch"))
    return F.concat_ws("|", F.coalesce(source, F.lit("")), scope, F.coalesce(record_id, hash_))


def keyed(events: DataFrame, adapters: list[Adapter] | None = None) -> DataFrame:
    """Adds ``adapter, x, record_id, payload_hash, event_key``. Only payloads without an id from an adapter go through Python."""
    # extraction is one large expression: it is evaluated once, not once for each column that is made of it; a few small
    # files are few tasks, so rows are dealt anew before it
    out = checkpointed(extract(spread(events), adapters)).withColumn("record_id", F.when(F.length(F.trim("x.record_id")) > 0, F.col("x.record_id")))
    unnamed = out.where("record_id is null").select("payload").distinct().mapInPandas(_sniff, "payload string, sniffed string")
    out = out.join(unnamed, (out["payload"] == unnamed["payload"]) & out["record_id"].isNull(), "left").drop(unnamed["payload"])
    out = out.withColumn("record_id", F.coalesce("record_id", "sniffed")).drop("sniffed").withColumn("payload_hash", payload_hash(F.col("payload")))
    return out.withColumn("event_key", event_key(F.col("source"), F.col("event_id"), F.col("batch_id"), F.col("record_id"), F.col("payload_hash")))


def classify(deliveries: DataFrame) -> DataFrame:
    """Adds ``status``: new, duplicate or conflict; ``deliveries`` has event_key, payload_hash, seq, idempotency_key and record_id.

    The idempotency key compares with the payload last stored under it, for the same record, among first deliveries. Only
    rows that have one are shuffled by it.
    """
    by_key = Window.partitionBy("event_key").orderBy("seq")
    out = deliveries.withColumn("__first", F.first("payload_hash").over(by_key)).withColumn("__nth", F.row_number().over(by_key))
    out = out.withColumn("__once", F.coalesce((F.col("__nth") == 1) & (F.length(F.trim("idempotency_key")) > 0), F.lit(False)))
    again = Window.partitionBy("idempotency_key", F.coalesce("record_id", "payload_hash")).orderBy("seq")
    scoped = out.where("__once").withColumn("__repeat", F.lag("payload_hash").over(again).eqNullSafe(F.col("payload_hash")))
    out = scoped.unionAll(out.where("not __once").withColumn("__repeat", F.lit(False)))
    status = F.when((F.col("__nth") > 1) & (F.col("payload_hash") != F.col("__first")), "conflict").when((F.col("__nth") > 1) | F.col("__repeat"), "duplicate").otherwise("new")
    return out.withColumn("status", status).drop("__first", "__nth", "__once", "__repeat")


def reason(status: Column, adapter: Column, x: Column) -> Column:
    """Why a delivery is quarantined; null for one that applies or is a duplicate."""
    return (
        F.when(status == "conflict", "event_id_payload_conflict").when(status == "duplicate", F.lit(None)).when(adapter.isNull(), "no_adapter_for_schema")
        .when(F.coalesce(F.length(F.trim(x["record_id"])) == 0, F.lit(True)), "missing_source_record_id")
    )


def counters(applied: DataFrame) -> DataFrame:
    """One row: received, accepted, duplicates, quarantined, corrected; ``applied`` has status, reason and mode."""
    ok = (F.col("status") == "new") & F.col("reason").isNull()
    return applied.agg(
        F.count("*").alias("received"), F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("reason").isNotNull()).alias("quarantined"), F.count_if(ok & (F.col("mode") == "authoritative_correction")).alias("corrected"),
    )


#: What tells deliveries apart; a log is searched by these columns alone.
KEYS = ["event_key", "payload_hash", "idempotency_key", "record_id", "seq"]
LOG = [*COLUMNS, "event_key", "payload_hash", "record_id", "seq"]
#: Bytes of a batch's keys up to which they are broadcast to the log; beyond, both sides are shuffled.
BROADCAST = 32 << 20


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The log in the order of seq; None where there is none."""
    try:
        return spark.read.parquet(path).select(LOG)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _of(log: DataFrame, keys: DataFrame, column: str, most: int) -> DataFrame:
    """Rows of the log whose ``column`` is among ``keys``, which are broadcast only when their measured size is small."""
    keys = checkpointed(keys.select(column).distinct())
    size = keys.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0
    return log.join(F.broadcast(keys) if size <= most else keys, column, "left_semi").select(KEYS)


def related(log: DataFrame, batch: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``KEYS`` of the stored rows that decide on a batch: those of its event keys, and of the event keys of its idempotency keys.

    Payloads of the log are not read. While the batch's keys are small, the log is not shuffled either.
    """
    light = log.select(KEYS)
    named = batch.where("length(trim(idempotency_key)) > 0")
    keys = batch.select("event_key").unionAll(_of(light, named, "idempotency_key", most).select("event_key"))
    return _of(light, keys, "event_key", most)


def delivered(events: DataFrame, log: DataFrame | None, adapters: list[Adapter] | None = None) -> DataFrame:
    """A batch with its keys, extracted once and numbered after the log's last row.

    Numbers follow the column ``ord`` if events has it, else the rows' order. They come from one range-partitioned sort:
    a partition's offset plus the place within.
    """
    last = (log.agg(F.max("seq")).first()[0] if log is not None else None) or 0
    ordered = events if "ord" in events.columns else events.withColumn("ord", F.monotonically_increasing_id())
    order = ["ord", "event_key", "payload_hash"]
    out = checkpointed(keyed(ordered.drop("seq"), adapters)).repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(out.withColumn("seq", F.monotonically_increasing_id() + F.lit(last + 1)).drop("ord"))


def statuses(batch: DataFrame, old: DataFrame | None) -> DataFrame:
    """``batch`` of ``delivered`` with ``status``, given the rows of the log that are ``related`` to it."""
    new = batch.withColumn("__new", F.lit(True))
    if old is not None:
        new = new.unionByName(old.select(KEYS), allowMissingColumns=True)
    return classify(new).where("__new").drop("__new")


def store(batch: DataFrame, old: DataFrame | None, path: str) -> int:
    """Appends the deliveries of ``delivered`` that the log lacks, the first of each; returns how many."""
    first = Window.partitionBy("event_key", "payload_hash").orderBy("seq")
    fresh = batch.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    if old is not None:
        fresh = fresh.join(old.select("event_key", "payload_hash").distinct(), ["event_key", "payload_hash"], "left_anti")
    fresh = checkpointed(fresh.select(LOG))
    if n := fresh.count():
        fresh.write.mode("append").parquet(path)
    return n


def append(events: DataFrame, path: str, adapters: list[Adapter] | None = None) -> int:
    """Appends deliveries that the log does not have yet, numbered after its last; returns how many."""
    log = read(events.sparkSession, path)
    batch = delivered(events, log, adapters)
    return store(batch, related(log, batch) if log is not None else None, path)


def healed(log: DataFrame) -> DataFrame:
    """The log without rows that an older writer stored twice: the first of each delivery stays."""
    by = Window.partitionBy("source", "batch_id", *[c for c in COLUMNS if c not in ("source", "batch_id")]).orderBy("seq")
    return log.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")
