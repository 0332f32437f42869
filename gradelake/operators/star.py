"""Quota-limited ranking: each institution's groups nominate by percentile within a quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import round_half_up

QUOTA, GROUPS, SECOND_ROUND, MIN_SHOWN = 2, 8, 6, 3


def ranking(wishes: DataFrame, quota: int = QUOTA) -> DataFrame:
    """Best wish of each user, ranked by percentile within institution and group.

    Columns: institution, star_group, user_id, percentile, order, tied, nominated,
    first_round (the first), second_round (within the quota and groups 1 to 6).
    """
    best = wishes.where("star_group is not null").groupBy("user_id").agg(F.min_by(F.struct("percentile", "institution", "star_group"), F.struct("wish_rank", "institution", "star_group")).alias("w"))
    best = best.select("user_id", "w.*")
    pos = Window.partitionBy("institution", "star_group")
    out = best.withColumn("order", F.row_number().over(pos.orderBy("percentile", "user_id")))
    out = out.withColumn("tied", F.count("*").over(Window.partitionBy("institution", "star_group", "percentile")) > 1)
    nominated = F.col("order") <= quota
    return out.select(
        "institution", "star_group", "user_id", round_half_up("percentile", 4).alias("percentile"), "order", "tied", nominated.alias("nominated"), (F.col("order") == 1).alias("first_round"),
        (nominated & (F.col("star_group") <= SECOND_ROUND)).alias("second_round"),
    )


def squeeze(ranked: DataFrame) -> DataFrame:
    """Institutions that take part in several groups: how many first-rounders compete in each set of groups."""
    side = F.when(F.col("star_group") <= 3, "1-3").when(F.col("star_group") <= 6, "4-6").otherwise("7-8")
    g = ranked.where("first_round").groupBy("institution", side.alias("group_set")).agg(F.count("*").alias("first_rounders"))
    return g.where("first_rounders > 1")


def coordinator(ranked: DataFrame, quota: int = QUOTA, groups: int = GROUPS) -> DataFrame:
    """Every institution and group: candidates, unused slots, crowded and empty."""
    seats = ranked.select("institution").distinct().withColumn("star_group", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    have = ranked.groupBy("institution", "star_group").agg(F.count("*").alias("candidates"))
    out = seats.join(have, ["institution", "star_group"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.select("institution", "star_group", "candidates", F.greatest(F.lit(0), F.lit(quota) - F.col("candidates")).cast("int").alias("unused"), (F.col("candidates") > quota).alias("crowded"), (F.col("candidates") == 0).alias("empty"))


def sensitivity(ranked: DataFrame, quota: int = QUOTA) -> DataFrame:
    """Whether each user would be nominated one place better or worse."""
    return ranked.select("user_id", "order", (F.greatest(F.col("order") - 1, F.lit(1)) <= quota).alias("if_better"), (F.col("order") + 1 <= quota).alias("if_worse"))


def student_view(ranked: DataFrame, least: int = MIN_SHOWN) -> DataFrame:
    """The exact order is hidden where fewer than ``least`` compete."""
    n = F.count("*").over(Window.partitionBy("institution", "star_group"))
    return ranked.withColumn("cohort", n).select("user_id", "cohort", F.when(F.col("cohort") >= least, F.col("order")).alias("order"), "nominated")
