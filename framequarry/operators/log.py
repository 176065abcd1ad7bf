"""The edit log: an append-only table of edits, and states as folds over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import ranked


def from_events(events: DataFrame) -> DataFrame:
    """(session, serial, ts, kind, k): events in their order within a session."""
    k = F.get_json_object("props", "$.k").cast("int")
    own = events.select(F.col("user_id").alias("session"), "ts", F.col("event_type").alias("kind"), k.alias("k"), "event_id")
    found = ranked(own, "session", F.date_trunc("hour", "ts"), ["ts", "event_id"], "serial")
    return found.select("session", (F.col("serial") + 1).alias("serial"), "ts", "kind", "k")


def as_of(log: DataFrame, serial: int) -> DataFrame:
    """The last edit of each key (session, kind) up to a serial."""
    last = F.max_by(F.struct("serial", "k"), "serial").alias("m")
    return log.where(F.col("serial") <= serial).groupBy("session", "kind").agg(last).select("session", "kind", "m.serial", "m.k")


def coalesced(log: DataFrame) -> DataFrame:
    """Consecutive edits of one kind as one entry: session, entry, kind, first
    and last serial, number of edits."""
    order = Window.partitionBy("session").orderBy("serial")
    fresh = F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1))
    numbered = log.withColumn("fresh", fresh).withColumn("entry", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("session", "entry", "kind").agg(F.min("serial").alias("first"), F.max("serial").alias("last"), F.count("*").alias("edits"))


def evicted(log: DataFrame, depth: int = 100) -> DataFrame:
    """Entries that a history of bounded depth has dropped, by session."""
    entries = coalesced(log).groupBy("session").agg(F.max("entry").alias("entries"))
    return entries.select("session", "entries", F.greatest(F.lit(0), F.col("entries") - depth).alias("evicted"))


def checkpoints(log: DataFrame, every: int = 10) -> DataFrame:
    """An anchor at each `every`-th serial, with the edits made since the anchor
    before."""
    anchors = log.where(F.col("serial") % every == 0).select("session", "serial", "ts")
    order = Window.partitionBy("session").orderBy("serial")
    return anchors.withColumn("since", F.col("serial") - F.coalesce(F.lag("serial").over(order), F.lit(0)))


def checkpoint(anchors: DataFrame, serial: int) -> DataFrame:
    """The anchors at one serial."""
    return anchors.where(F.col("serial") == serial)


def without_checkpoint(anchors: DataFrame, serial: int) -> DataFrame:
    return anchors.where(F.col("serial") != serial)


def without_session(anchors: DataFrame, session: int) -> DataFrame:
    return anchors.where(F.col("session") != session)
