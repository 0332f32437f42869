"""Calendar rules: exam dates, admission years, local days, staleness and trust of looked-up figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

OLD_DAYS, OFFSET = 365, "INTERVAL 8 HOURS"
FIRST, LAST = 100, 200
LEVELS = ("WEAK", "WORKABLE", "SOLID")


def exam_date(year) -> Column:
    """20 January of the year after a ROC year (UTC); null outside 100..200."""
    y = col(year).cast("int")
    return F.when(y.between(FIRST, LAST), F.make_date(y + 1912, F.lit(1), F.lit(20)).cast("timestamp"))


def upcoming_year(now) -> Column:
    """The ROC year of the next exam; the exam's own moment still counts as ahead."""
    t = col(now)
    y = (F.year(t) - 1912).cast("int")
    return F.when(t <= exam_date(y), y).otherwise(y + 1)


def exam_passed(year, now) -> Column:
    return F.coalesce(col(now) > exam_date(year), F.lit(False))


def local_day(at) -> Column:
    """The day at UTC+8."""
    return F.date_format(col(at) + F.expr(OFFSET), "yyyy-MM-dd")


def local_minutes(at) -> Column:
    t = col(at) + F.expr(OFFSET)
    return F.hour(t) * 60 + F.minute(t)


def day_range(first, last) -> tuple[Column, Column]:
    """Half-open [start of the first day, start of the day after the last) at UTC+8; null for what is no date."""
    start = lambda d, plus: F.date_add(F.try_to_timestamp(col(d), F.lit("yyyy-MM-dd")).cast("date"), plus).cast("timestamp") - F.expr(OFFSET)
    return start(first, 0), start(last, 1)


def stale_years(year, stale_after, current) -> Column:
    return F.greatest(F.lit(0), F.coalesce(col(current) - F.coalesce(col(stale_after), col(year)), F.lit(0)))


def age_days(looked_up, now) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(col(now)) - F.unix_timestamp(col(looked_up))) / 86400))


def trust(source_trust, stale, days) -> Column:
    """SOLID (sources of 3 or more), WORKABLE (1 or more) or WEAK; a stale year and an old look-up each cost one step."""
    base = F.when(col(source_trust) >= 3, 2).when(col(source_trust) >= 1, 1).otherwise(0)
    down = F.when(col(stale) > 0, 1).otherwise(0) + F.when(col(days) > OLD_DAYS, 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.greatest(F.lit(0), base - down) + 1).cast("int"))
