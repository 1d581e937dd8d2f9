"""State of records from their events, where no event reads another record: windows over a record's events.

These are the set-based forms of the fold's rules for histories without corrections; ``events`` has record, seq and clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale_gate(events: DataFrame) -> DataFrame:
    """Adds ``applied``: an event older than the newest clock that arrived before it is history only."""
    before = Window.partitionBy("record").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("clock").over(before)
    return events.withColumn("applied", newest.isNull() | F.col("clock").isNull() | (F.col("clock") >= newest))


def current(events: DataFrame, value: Column, patch: bool) -> DataFrame:
    """``record, value``: of the latest applied event; with patches the latest that supplies one."""
    rows = events.where("applied").withColumn("__v", value)
    rows = rows.where("__v is not null") if patch else rows
    return rows.groupBy("record").agg(F.max_by("__v", F.struct("clock", "seq")).alias("value"))


def lifecycle(events: DataFrame, tombstone: Column) -> DataFrame:
    """``record, lifecycle, reactivations``: a tombstone makes a record inactive, any later event active again."""
    order = Window.partitionBy("record").orderBy("seq")
    rows = events.withColumn("__t", tombstone).withColumn("__back", ~F.col("__t") & F.coalesce(F.lag("__t").over(order), F.lit(False)))
    return rows.groupBy("record").agg(F.when(F.max_by("__t", "seq"), "inactive").otherwise("active").alias("lifecycle"), F.count_if("__back").alias("reactivations"))


def assignment_audit(events: DataFrame, assigned: Column) -> DataFrame:
    """Changes of an assignment, with what it was before."""
    order = Window.partitionBy("record").orderBy("seq")
    rows = events.withColumn("new", assigned).withColumn("prior", F.lag(assigned).over(order))
    return rows.where("prior is not null and not (prior <=> new)").select("record", "seq", "prior", "new")


def next_epoch(events: DataFrame) -> DataFrame:
    """``source, record, epoch``: one more than the greatest lifecycle epoch that any event of the record declares; 1 without one."""
    return events.groupBy("source", "record").agg((F.coalesce(F.max("epoch"), F.lit(0)) + 1).alias("epoch"))
