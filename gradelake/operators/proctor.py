"""Sittings under supervision: away segments, summaries, class baselines and what stands out (batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MERGE_MS, SHORT_MS, LONG_MS, MIN_STUDENTS, WIDE, MANY = 2_000, 1_500, 30_000, 5, 0.6, 3
LONGEST_MS, MAX_EVENTS, LATE_MS = 120_000, 1_000, 300_000


def sessions(events: DataFrame, gap_ms: int, keys: list[str]) -> DataFrame:
    """Gaps and islands: events of a key that follow within ``gap_ms`` are one session.

    events: keys, at (timestamp), event_id.  One shuffle by key; a new session begins where the gap is longer.
    """
    w = Window.partitionBy(*keys).orderBy("at", "event_id")
    ms = F.unix_millis("at")
    e = events.withColumn("new", F.coalesce((ms - F.lag(ms).over(w) > gap_ms).cast("int"), F.lit(1)))
    e = e.withColumn("session", F.sum("new").over(w))
    return e.groupBy(*keys, "session").agg(F.count("*").alias("events"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), (F.max(ms) - F.min(ms)).alias("length_ms"))


def summary(events: DataFrame) -> DataFrame:
    """Per attempt: events, away count, time and longest, pastes, and fullscreen exits.

    Exits are a running count that a quick return takes back, never below 0: with
    running sum S the floored count is S - min(0, least S so far).
    """
    away = F.col("type") == "TAB_VISIBLE"
    w = Window.partitionBy("attempt_id").orderBy("at", "event_id")
    step = F.when(F.col("type") == "FULLSCREEN_EXIT", 1).when((F.col("type") == "FULLSCREEN_ENTER") & (F.col("duration_ms") < SHORT_MS), -1).otherwise(0)
    e = events.withColumn("s", F.sum(step).over(w))
    e = e.withColumn("low", F.least(F.lit(0), F.min("s").over(w)))
    g = e.groupBy("attempt_id").agg(
        F.count("*").alias("events"), F.count_if(away).alias("away"), F.coalesce(F.sum(F.when(away, F.col("duration_ms"))), F.lit(0)).alias("away_ms"), F.coalesce(F.max(F.when(away, F.col("duration_ms"))), F.lit(0)).alias("longest_ms"),
        F.count_if(F.col("type") == "PASTE").alias("pastes"), F.max_by(F.col("s") - F.col("low"), F.struct("at", "event_id")).alias("exits"),
    )
    return g.withColumn("exits", F.col("exits").cast("long"))


def baseline(summaries: DataFrame, group: str) -> DataFrame:
    """Per group: students, median (rounded) and most away, how many have any, and whether it is widespread."""
    g = summaries.groupBy(group).agg(F.count("*").alias("students"), F.floor(F.percentile("away", 0.5) + 0.5).alias("median"), F.max("away").alias("most"), F.count_if(F.col("away") > 0).alias("with_events"), F.count_if(F.col("away") >= MANY).alias("with_many"))
    wide = (F.col("students") >= MIN_STUDENTS) & (F.col("with_many") >= F.col("students") * WIDE)
    return g.select(group, "students", "median", "most", "with_events", wide.alias("widespread"))


def outliers(summaries: DataFrame, base: DataFrame, group: str) -> DataFrame:
    """Attempts that stand out from their group, unless what they did is widespread there."""
    j = summaries.join(base, group)
    out = (F.col("away") >= F.greatest(2 * F.col("median"), F.lit(3))) | (F.col("longest_ms") >= LONGEST_MS)
    j = j.where(out & ~F.col("widespread"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("away"), F.desc("longest_ms"), "attempt_id"))
    return j.select(group, "attempt_id", "away", "longest_ms", nth.alias("position"))


def late_filter(events: DataFrame, closes: DataFrame, late_ms: int = LATE_MS, most: int = MAX_EVENTS) -> DataFrame:
    """Each event's fate: CLOSED later than ``late_ms`` after the sitting closed, FULL beyond ``most`` an attempt, else OK."""
    j = events.join(closes, "attempt_id")
    late = F.unix_millis("at") > F.unix_millis("closed_at") + late_ms
    w = Window.partitionBy("attempt_id", late).orderBy("at", "event_id")
    nth = F.row_number().over(w)
    return j.withColumn("late", late).withColumn("nth", nth).select("event_id", "attempt_id", F.when(F.col("late"), "CLOSED").when(F.col("nth") > most, "FULL").otherwise("OK").alias("fate"))


def away_segments(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Raw signals (keys, seq, kind, at_ms) to away records: keys, type, at_ms, duration_ms, bursts.

    Away is hidden or without focus.  Absences with at most MERGE_MS between them are one,
    merged ones below SHORT_MS go, those of LONG_MS or more are LONG_ABSENCE; one that has
    not ended has no record, and neither has what it continues.  Running flags and two island
    numbers over one partitioning by key.
    """
    w = Window.partitionBy(*keys).orderBy("at_ms", "seq")
    flag = lambda on, off: F.coalesce(F.last(F.when(F.col("kind") == on, True).when(F.col("kind") == off, False), ignorenulls=True).over(w), F.lit(False))
    s = signals.withColumn("hid", flag("hidden", "visible")).withColumn("away", F.col("hid") | flag("blur", "focus"))
    s = s.withColumn("was", F.coalesce(F.lag("away").over(w), F.lit(False)))
    s = s.withColumn("seg", F.sum((F.col("away") & ~F.col("was")).cast("int")).over(w)).where("away or was")
    seg = s.groupBy(*keys, "seg").agg(F.min("at_ms").alias("start"), F.max(F.when(~F.col("away"), F.col("at_ms"))).alias("end"), F.bool_or(F.col("hid") & F.col("away")).alias("hid"))
    order = Window.partitionBy(*keys).orderBy("seg")
    new = F.coalesce(F.col("start") - F.lag("end").over(order) > MERGE_MS, F.lit(True))
    seg = seg.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    g = seg.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("at_ms"), F.bool_or("hid").alias("hid"), F.bool_or(F.col("end").isNull()).alias("open"), F.count("*").alias("bursts"))
    g = g.withColumn("duration_ms", F.col("at_ms") - F.col("start")).where(~F.col("open") & (F.col("duration_ms") >= SHORT_MS))
    kind = F.when(F.col("duration_ms") >= LONG_MS, "LONG_ABSENCE").when(F.col("hid"), "TAB_VISIBLE").otherwise("WINDOW_FOCUS")
    return g.select(*keys, kind.alias("type"), "at_ms", "duration_ms", "bursts")


def pastes(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Pastes (keys, seq, at_ms, chars) that follow within MERGE_MS as one: the last moment, characters and count."""
    w = Window.partitionBy(*keys).orderBy("at_ms", "seq")
    s = signals.withColumn("new", F.coalesce((F.col("at_ms") - F.lag("at_ms").over(w) > MERGE_MS).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return s.groupBy(*keys, "run").agg(F.max("at_ms").alias("at_ms"), F.sum(F.greatest(F.coalesce("chars", F.lit(0)), F.lit(0))).alias("chars"), F.count("*").alias("count")).drop("run")
