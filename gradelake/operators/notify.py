"""Notifications: deduplication, quiet hours, throttling (a sequential fold per recipient) and delivery states."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE_MS, DAY_MIN, OFFSET_MIN = 60_000, 1440, 480
WINDOW_MS, PER_WINDOW, ROUNDS = 60_000, 3, 64


def in_quiet_hours(minute: int, start: int | None, end: int | None) -> bool:
    """Whether a minute of the day is quiet; equal ends mean none; a span may pass midnight."""
    if start is None or end is None or start == end:
        return False
    return start <= minute < end if start < end else minute >= start or minute < end


def quiet_until(at_ms: int, start: int | None, end: int | None, offset: int = OFFSET_MIN) -> int:
    """The first moment from ``at_ms`` that is not quiet (local time is UTC + ``offset`` minutes)."""
    minute = (at_ms // MINUTE_MS + offset) % DAY_MIN
    if not in_quiet_hours(minute, start, end):
        return at_ms
    return at_ms // MINUTE_MS * MINUTE_MS + ((end - minute) % DAY_MIN or DAY_MIN) * MINUTE_MS


def throttle(sent: Iterable[int], at_ms: int, per: int = PER_WINDOW, window: int = WINDOW_MS) -> int:
    """The earliest moment from ``at_ms`` with fewer than ``per`` sent in the window before it."""
    near = sorted(s for s in sent if s > at_ms - window)
    while sum(at_ms - window < s <= at_ms for s in near) >= per:
        at_ms = [s for s in near if s <= at_ms][-per] + window
    return at_ms


def schedule(sent: list[int], at_ms: int, start: int | None, end: int | None) -> int:
    """Throttle and quiet hours until neither moves the time."""
    for _ in range(ROUNDS):
        then = quiet_until(throttle(sent, at_ms), start, end)
        if then == at_ms:
            break
        at_ms = then
    return at_ms


def _per_user(pdf: pd.DataFrame) -> pd.DataFrame:
    sent: list[int] = []
    out = []
    for r in pdf.sort_values(["at_ms", "note_id"]).itertuples():
        none = pd.isna(r.quiet_start) or pd.isna(r.quiet_end)
        at = schedule(sent[-8 * PER_WINDOW :], int(r.at_ms), None if none else int(r.quiet_start), None if none else int(r.quiet_end))
        sent.append(at)
        sent.sort()
        out.append((r.user_id, r.note_id, int(r.at_ms), at))
    return pd.DataFrame(out, columns=["user_id", "note_id", "at_ms", "send_ms"])


def schedule_all(notes: DataFrame) -> DataFrame:
    """notes: user_id, note_id, at_ms, quiet_start, quiet_end (minutes, null: none) to send_ms, recipient by recipient."""
    return notes.groupBy("user_id").applyInPandas(_per_user, "user_id long, note_id long, at_ms long, send_ms long")


def dedupe(notes: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("tenant_id", "dedupe_key")) -> DataFrame:
    """New notes, the first of each key, without those that are known."""
    g = notes.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in notes.columns if c not in keys]), "note_id").alias("r"))
    return g.select(*keys, "r.*").join(known.select(*keys).distinct(), list(keys), "left_anti")


def next_state(status: Column, tries: Column, ok: Column, stale: Column) -> tuple[Column, Column]:
    """Delivery: (status, minutes until the next try): stale ones are dropped, failures back off to 15 minutes and end after 5."""
    after = F.when(stale, "SKIPPED").when(ok, "SENT").when(tries + 1 >= 5, "FAILED").otherwise("PENDING")
    wait = F.when(~stale & ~ok & (tries + 1 < 5), F.least(F.lit(15.0), F.pow(F.lit(2.0), tries)))
    return F.when(status == "PENDING", after).otherwise(status), F.when(status == "PENDING", wait)


def quiet(minute: Column, start: Column, end: Column) -> Column:
    """``in_quiet_hours`` as an expression over minutes of the day."""
    inside = F.when(start < end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))
    return F.coalesce(F.when(start != end, inside), F.lit(False))


def quiet_end(at_ms: Column, start: Column, end: Column, offset: int = OFFSET_MIN) -> Column:
    """``quiet_until`` as an expression: the first moment that is not quiet."""
    minute = F.pmod(F.floor(at_ms / MINUTE_MS) + offset, F.lit(DAY_MIN))
    wait = F.pmod(end - minute, F.lit(DAY_MIN))
    then = F.floor(at_ms / MINUTE_MS) * MINUTE_MS + F.when(wait == 0, DAY_MIN).otherwise(wait) * MINUTE_MS
    return F.when(quiet(minute, start, end), then).otherwise(at_ms).cast("long")


def minute_of_day(text: Column) -> Column:
    """HH:MM as a minute of the day, else null."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(text), "^([01]?[0-9]|2[0-3]):([0-5][0-9])$", i), F.lit("")).cast("int")
    return part(1) * 60 + part(2)
