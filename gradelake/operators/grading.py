"""Whole-paper grading, re-grading, proposals, votes and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grading as G
from ..functions.numeric import clamp, round_half_up, share, wilson

#: Bands of stated confidence (low, high); the last is closed above.
BANDS = [(0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.0)]
MIN_CALIBRATION, MARGIN, MIN_ACCURACY = 10, 0.15, 20


def grade_items(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Every item of a paper against a response, which may be missing (blank).

    items: paper_id, question_id, order, type, score, correct_keys, option_count, award_all.
    responses: attempt_id, paper_id, question_id, answer_keys, answer_text, answer_slots.
    Types other than SINGLE, TRUE_FALSE and MULTI are left to people (null).
    """
    # responses travel once by attempt and once by paper, whole papers never: an item meets its response inside the attempt's row
    rest = [c for c in responses.columns if c not in ("attempt_id", "paper_id")]
    attempts = responses.groupBy("attempt_id", "paper_id").agg(F.collect_list(F.struct(*rest)).alias("given"))
    r = attempts.join(items, "paper_id").withColumn("given", F.explode_outer(F.filter("given", lambda x: x["question_id"] == F.col("question_id"))))
    r = r.select(*[c for c in r.columns if c != "given"], *[F.col(f"given.{c}").alias(c) for c in rest if c != "question_id"])
    auto = F.when(F.col("type").isin("SINGLE", "TRUE_FALSE"), G.single_choice("answer_keys", "correct_keys", "score")).when(F.col("type") == "MULTI", G.multi_choice("answer_keys", "correct_keys", "option_count", "score"))
    r = r.withColumn("answered", F.coalesce(F.size("answer_keys") > 0, F.lit(False))).withColumn("auto", auto)
    earned = F.when(F.col("award_all"), F.col("score")).otherwise(F.col("auto"))
    return r.select("attempt_id", "question_id", "order", "type", "score", "answered", earned.alias("earned"), G.verdict("answered", "auto", "score").alias("verdict"))


def attempt_totals(graded: DataFrame) -> DataFrame:
    """Per attempt: items, auto and its most, correct, pending; GRADED only if nothing pends."""
    g = graded.groupBy("attempt_id").agg(
        F.count("*").alias("items"), round_half_up(F.sum("earned"), 6).alias("auto"), F.sum(F.when(F.col("earned").isNotNull(), F.col("score"))).alias("auto_max"),
        F.count_if(F.col("verdict") == "CORRECT").alias("correct"), F.count_if(F.col("verdict") == "PENDING").alias("pending"),
    )
    return g.withColumn("status", F.when(F.col("pending") == 0, "GRADED").otherwise("SUBMITTED"))


def regrade_diff(old: DataFrame, new: DataFrame, key: str = "attempt_id", value: str = "total") -> DataFrame:
    """Keys whose value changed, with both values (null counts as a value)."""
    a, b = old.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def sample_consensus(samples: DataFrame, key: str, most: float = 25.0) -> DataFrame:
    """Per key of (suggested_score, confidence) samples: median, spread, unstable, representative, confidence."""
    mid = samples.groupBy(key).agg(F.count("*").alias("n"), F.percentile("suggested_score", 0.5).alias("median"), (F.max("suggested_score") - F.min("suggested_score")).alias("spread"), F.avg("confidence").alias("mean"))
    near = samples.join(mid.select(key, "median"), key).groupBy(key).agg(F.min(F.struct(F.abs(F.col("suggested_score") - F.col("median")).alias("off"), F.col("suggested_score").alias("s"))).alias("near"))
    m = mid.join(near, key).withColumn("ratio", F.col("spread") / most).withColumn("unstable", F.col("ratio") > 0.15)
    c = F.col("mean") * (1 - F.col("ratio")) * F.when(F.col("n") == 1, 0.7).otherwise(1.0)
    c = F.when(F.col("unstable"), F.least(c, F.lit(0.4))).otherwise(c)
    return m.select(key, "n", "median", round_half_up("spread", 6).alias("spread"), "unstable", F.col("near.s").alias("representative"), round_half_up(clamp(c, 0.02, 0.95), 4).alias("confidence"))


def proposal_accuracy(p: DataFrame, group: list[str], enough: int = MIN_ACCURACY) -> DataFrame:
    """p: state (ACCEPTED, CHANGED, PENDING), suggested, final, full; errors are final - suggested."""
    decided, changed = F.col("state") != "PENDING", F.col("state") == "CHANGED"
    err = F.when(decided, F.col("final") - F.col("suggested"))
    g = p.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(decided).alias("decided"), F.count_if(F.col("state") == "ACCEPTED").alias("accepted"), F.count_if(changed).alias("changed"),
        round_half_up(F.avg(F.abs(err)), 4).alias("mae"), round_half_up(F.avg(F.when(changed, F.abs(err))), 4).alias("mae_changed"), round_half_up(F.avg(err), 4).alias("bias"), round_half_up(F.avg(F.abs(err) / F.col("full")), 4).alias("relative"),
    )
    return g.withColumn("adoption", share("accepted", "decided")).withColumn("enough", F.col("decided") >= enough)


def vote_tally(votes: DataFrame, key: str, asked: int) -> DataFrame:
    """Per key the most frequent answer (first seen on ties; an empty one counts 0), consistency = votes / asked, autofill."""
    norm = F.array_join(F.array_sort(F.array_distinct("answer_keys")), ",")
    each = votes.select(key, norm.alias("answer"), "attempt_idx").groupBy(key, "answer").agg(F.count("*").alias("votes"), F.min("attempt_idx").alias("first"))
    best = each.groupBy(key).agg(F.max_by(F.struct("answer", "votes"), F.struct("votes", -F.col("first"))).alias("b"))
    v = F.when(F.col("b.answer") == "", 0).otherwise(F.col("b.votes"))
    c = round_half_up(v / asked, 4)
    return best.select(key, F.col("b.answer").alias("answer"), v.alias("votes"), c.alias("consistency"), F.when(c >= 0.99, "high").when(c >= 0.6, "mid").otherwise("low").alias("tier"), (c >= 0.6).alias("autofill"))


def calibration_curve(rows: DataFrame, group: list[str]) -> DataFrame:
    """Stated confidence against hits, band by band; rows: interval_low, interval_high, confidence, actual_grade.

    Every band appears for every group.  Rows without an actual grade are pending;
    rows whose interval or confidence makes no sense are malformed and left out.
    """
    fine = (F.col("interval_low") <= F.col("interval_high")) & (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    band = F.lit(len(BANDS) - 1)
    for i, (_, high) in reversed(list(enumerate(BANDS[:-1]))):
        band = F.when(F.col("confidence") < high, i).otherwise(band)
    hit = F.col("actual_grade").between(F.col("interval_low"), F.col("interval_high"))
    g = rows.where(fine & F.col("actual_grade").isNotNull()).groupBy(*group, band.alias("band")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"), F.avg("confidence").alias("claimed"))
    frame = rows.select(*group).distinct().withColumn("band", F.explode(F.array(*[F.lit(i) for i in range(len(BANDS))])))
    low, high = wilson("hit", "n")
    out = frame.join(g, [*group, "band"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hit": F.coalesce("hit", F.lit(0))}).withColumns({"low": low, "high": high})
    rate = F.col("hit") / F.nullif("n", F.lit(0))
    sure = (F.col("n") >= MIN_CALIBRATION)
    alert = F.when(sure & (F.col("claimed") - rate > MARGIN) & (F.col("high") < F.col("claimed")), "OVER").when(sure & (rate - F.col("claimed") > MARGIN) & (F.col("low") > F.col("claimed")), "UNDER")
    return out.select(*group, "band", "n", "hit", share("hit", "n").alias("hit_rate"), round_half_up("claimed", 4).alias("claimed"), round_half_up("low", 4).alias("low"), round_half_up("high", 4).alias("high"), alert.alias("alert"))


def calibration_counts(rows: DataFrame, group: list[str]) -> DataFrame:
    fine = F.coalesce((F.col("interval_low") <= F.col("interval_high")) & (F.col("confidence") > 0) & (F.col("confidence") <= 1), F.lit(False))
    return rows.groupBy(*group).agg(F.count_if(~fine).alias("malformed"), F.count_if(fine & F.col("actual_grade").isNull()).alias("pending"), F.count_if(fine & F.col("actual_grade").isNotNull()).alias("known"))


def review_order(p: DataFrame, key: str) -> DataFrame:
    """Positions in a review queue: no proposal first, then unstable, then by confidence, decided last."""
    rank = F.when(F.col("state") != "PENDING", 10.0).when(F.col("suggested").isNull(), -2.0).when(F.col("unstable"), -1.0).otherwise(F.col("confidence"))
    ranked = p.withColumn("priority", rank)
    return ranked.select(key, "question_id", "priority", F.row_number().over(Window.partitionBy("question_id").orderBy("priority", key)).alias("position"))
