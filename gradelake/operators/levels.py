"""Cohort-relative levels: top one percent, level intervals, five standards, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import round_half_up

MIN_COHORT = 300
#: Nearest-rank percents of the five standards, from the top.
STANDARDS = {"top": 88, "front": 75, "average": 50, "back": 25, "bottom": 12}


def top_one_percent(scores: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: n, nominal size max(1, ceil(n / 100)), size with ties, and the mean of those scores."""
    w = Window.partitionBy(group)
    r = scores.withColumn("n", F.count("*").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc(score))))
    r = r.withColumn("nominal", F.greatest(F.lit(1), F.ceil(F.col("n") / 100)))
    top = r.where(F.col("rank") <= F.col("nominal"))
    return top.groupBy(group).agg(F.max("n").alias("n"), F.max("nominal").cast("long").alias("nominal"), F.count("*").alias("with_ties"), F.avg(score).alias("top_mean"))


def interval(top_mean: Column) -> Column:
    """A fifteenth of the top mean, to five places."""
    return F.floor((top_mean / 15 + 2.220446049250313e-16) * 1e5 + 0.5) / 1e5


def level(raw: Column, step: Column) -> Column:
    """0 for nothing, else ceil(raw / step - 1e-9), at most 15."""
    return F.when(raw <= 0, 0).otherwise(F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(raw / step - 1e-9)))).cast("int")


def levels(scores: DataFrame, group: str, score: str, anchor: float | None = None, min_cohort: int = MIN_COHORT) -> DataFrame:
    """Each row's level: method COHORT for large enough groups, else from an anchor interval, else none."""
    top = top_one_percent(scores, group, score).select(group, F.col("n").alias("cohort"), interval(F.col("top_mean")).alias("own_step"))
    s = scores.join(top, group)
    big = F.col("cohort") >= min_cohort
    method = F.when(big, "COHORT").otherwise("HISTORICAL_ANCHOR" if anchor else "UNAVAILABLE")
    step = F.when(big, F.col("own_step")).otherwise(F.lit(anchor).cast("double"))
    return s.withColumn("method", method).withColumn("step", step).withColumn("level", level(F.col(score), F.col("step")))


def level_table(steps: DataFrame, group: str) -> DataFrame:
    """Sixteen rows a group with the scores that each level spans."""
    g = steps.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(15))))
    low = F.when(F.col("level") == 0, 0.0).otherwise(round_half_up((F.col("level") - 1) * F.col("step"), 2))
    return g.select(group, "level", low.alias("above"), round_half_up(F.col("level") * F.col("step"), 2).alias("up_to"))


def five_standards(values: DataFrame, group: str, value: str, min_cohort: int = MIN_COHORT) -> DataFrame:
    """Nearest-rank standards per group; null below ``min_cohort`` rows.

    The counts per value are summed first, so that the ranking window holds one row a value.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    run = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    pick = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / F.lit(100)), F.col(value))).alias(name) for name, p in STANDARDS.items()]
    out = run.groupBy(group).agg(F.max("n").alias("n"), *pick)
    return out.select(group, "n", *[F.when(F.col("n") >= min_cohort, F.col(x)).alias(x) for x in STANDARDS])
