"""Sessions: runs of a key's events without a pause. An extension of the audits; the same function serves streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, on: Sequence[str], time: str, *, gap: str = "30 minutes", aggregates: dict[str, Column] | None = None, late: str | None = None) -> DataFrame:
    """on, session_start, session_last, n_events and the aggregates, a row for each session.

    An event belongs to the session of the one before it if no more than `gap` lies between.
    Events without a time are of none; a null key has sessions like any other. Rows that repeat count each time. An empty table gives no rows.

    late: for streams, how long an event may come after later ones; sessions are told once the watermark passes their end, and
    state is bounded by it. A key's events are sorted by one task, as a stream; where a key holds a large share of all
    events, set spark.sql.sessionWindow.merge.sessions.in.local.partition, and each task merges its own events to sessions before the shuffle.
    """
    own = events.where(F.col(f"`{time}`").isNotNull())
    if late is not None:
        own = own.withWatermark(time, late)
    found = own.groupBy(*[F.col(f"`{c}`") for c in on], F.session_window(F.col(f"`{time}`"), gap).alias("_session")).agg(
        F.min(F.col(f"`{time}`")).alias("session_start"), F.max(F.col(f"`{time}`")).alias("session_last"), F.count(F.lit(1)).alias("n_events"), *[c.alias(n) for n, c in (aggregates or {}).items()]
    )
    return found.drop("_session")
