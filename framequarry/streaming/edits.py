"""Streams of edits: an extension, as the tables of a log may grow while they
are read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def edits(events: DataFrame) -> DataFrame:
    """(session, serial, ts, kind, k) of a stream of events; the event's id is
    the serial."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("serial"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), k.alias("k"))


def per_window(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Edits of each kind in windows of event time; what comes later than the
    watermark is left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("edits"))


_OUT = "session long, kind string, first long, last long, edits long"
_STATE = "kind string, first long, last long, edits long"


def _merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    run = state.get if state.exists else None
    done = []
    for serial, kind in pd.concat(list(batches)).sort_values("serial")[["serial", "kind"]].itertuples(index=False):
        if run and run[0] == kind:
            run = (kind, run[1], int(serial), run[3] + 1)
        else:
            if run:
                done.append((key[0], *run))
            run = (kind, int(serial), int(serial), 1)
    if run:
        state.update(run)
    yield pd.DataFrame(done, columns=["session", "kind", "first", "last", "edits"])


def coalesced(stream: DataFrame) -> DataFrame:
    """Consecutive edits of one kind as one entry, given out when the next kind
    comes; only the run that is open is kept as state."""
    return stream.groupBy("session").applyInPandasWithState(_merge, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
