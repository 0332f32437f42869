"""Sittings under supervision as a stream: windows, sessions, deduplication, late events and throttled notices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.notify import PER_WINDOW, throttle

LATE = "5 minutes"


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = LATE, at: str = "at", by: str = "type") -> DataFrame:
    """Events per window and type; a window closes when the watermark has passed it."""
    g = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), by, "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = LATE, key: str = "user_id", at: str = "at") -> DataFrame:
    """Runs of events of a key with no gap of ``gap`` or longer; ``ended_at`` is the last event's time."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events"), F.max(at).alias("ended_at"))
    return g.select(key, F.col("w.start").alias("started_at"), "ended_at", "events")


def first_only(events: DataFrame, keys: list[str], late: str = LATE, at: str = "at") -> DataFrame:
    """Drops repeats of a key that come within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def on_time(events: DataFrame, closes: DataFrame, late_ms: int = 300_000) -> DataFrame:
    """Events of sittings (a static table: attempt_id, closed_at) up to ``late_ms`` after they closed."""
    return events.join(closes, "attempt_id").where(F.unix_millis("at") <= F.unix_millis("closed_at") + late_ms).drop("closed_at")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sent = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values(["at_ms", "note_id"])
    out = []
    for note, at in zip(rows["note_id"], rows["at_ms"], strict=True):
        send = throttle(sent, int(at))
        sent = sorted([*sent, send])[-8 * PER_WINDOW :]
        out.append((key[0], int(note), int(at), send))
    state.update((sent,))
    yield pd.DataFrame(out, columns=["user_id", "note_id", "at_ms", "send_ms"])


def throttled(notes: DataFrame) -> DataFrame:
    """Notices of each recipient at most three a minute, in order of arrival; the times of the last ones are the state.

    notes: user_id, note_id, at_ms.
    """
    return notes.groupBy("user_id").applyInPandasWithState(_fold, "user_id long, note_id long, at_ms long, send_ms long", "sent array<long>", "append", GroupStateTimeout.NoTimeout)
