"""Decayed mastery of knowledge points, trailing streaks, weakness and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp, round_half_up, share
from .stats import finished

#: Prior weight; answers and evidence that make a figure reliable; weak below; streak that counts as stuck.
PRIOR, MIN_ANSWERS, MIN_EVIDENCE, WEAK, STUCK = 2.0, 5, 2.5, 0.5, 3
LATEST_ATTEMPTS = 400


def decay_weight(age_days: Column, rate: Column) -> Column:
    """exp(-rate * age / 7): 1 at age 0 and at rate 0; a negative age counts as 0."""
    return F.when(rate == 0, F.lit(1.0)).otherwise(F.exp(-rate * F.greatest(age_days, F.lit(0.0)) / 7.0))


def difficulty_factor(correct: Column, difficulty: Column) -> Column:
    d = F.coalesce(clamp(difficulty, 0.0, 1.0), F.lit(0.5))
    return 1.0 + 0.6 * F.when(correct, d - 0.5).otherwise(0.5 - d)


def _age(at: Column, now) -> Column:
    return (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)) / 86400.0


def graded_answers(attempts: DataFrame, answers: DataFrame, questions: DataFrame, latest: int = LATEST_ATTEMPTS) -> DataFrame:
    """Graded answers of each user's latest finished attempts, one row per linked knowledge point."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("attempt_id")))
    recent = finished(attempts).withColumn("nth", nth).where(F.col("nth") <= latest).select("attempt_id", "user_id")
    return answers.where("is_correct is not null").join(recent, "attempt_id").join(questions, "question_id")


def snapshots(rows: DataFrame, now) -> DataFrame:
    """Per user and knowledge point: total, correct, evidence, mastery, reliable, last_answered_at."""
    link = F.when(F.col("weight") == 0, 1e-6).otherwise(clamp("weight", 0.0, 1.0))
    w = decay_weight(_age(F.col("answered_at"), now), F.col("decay_rate")) * link * difficulty_factor(F.col("is_correct"), F.col("difficulty"))
    g = rows.withColumn("w", w).groupBy("user_id", "kp_id").agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.sum("w").alias("sum_w"), F.sum(F.when(F.col("is_correct"), F.col("w")).otherwise(0.0)).alias("sum_c"), F.max("answered_at").alias("last_answered_at")
    )
    return g.select(
        "user_id", "kp_id", "total", "correct", round_half_up("sum_w", 4).alias("evidence"), round_half_up(F.col("sum_c") / (F.col("sum_w") + PRIOR), 4).alias("mastery"),
        ((F.col("total") >= MIN_ANSWERS) & (F.col("sum_w") >= MIN_EVIDENCE)).alias("reliable"), "last_answered_at",
    )


def wrong_streak(rows: DataFrame) -> DataFrame:
    """Wrong answers since the last right one, in the order (answered_at, attempt_id, question_id)."""
    at = F.struct("answered_at", "attempt_id", "question_id")
    key = Window.partitionBy("user_id", "kp_id")
    last = rows.select("user_id", "kp_id", "is_correct", at.alias("at")).withColumn("last_ok", F.max(F.when(F.col("is_correct"), F.col("at"))).over(key))
    return last.groupBy("user_id", "kp_id").agg(F.count_if(F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))).alias("wrong_streak"))


def class_weakness(snaps: DataFrame, users: DataFrame, enough: int = 3) -> DataFrame:
    """Per class and knowledge point: students, reliable, weak, mean mastery of the reliable, enough."""
    sure = F.col("reliable")
    g = snaps.join(users.select("user_id", "class_id"), "user_id").groupBy("class_id", "kp_id")
    out = g.agg(F.count("*").alias("students"), F.count_if(sure).alias("n_reliable"), F.count_if(sure & (F.col("mastery") < WEAK)).alias("weak"), round_half_up(F.avg(F.when(sure, F.col("mastery"))), 4).alias("mean_mastery"))
    return out.withColumn("enough", F.col("n_reliable") >= enough)


def type_breakdown(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question type: answered (graded), correct, pending, rate (null where nothing is graded)."""
    g = answers.join(questions.select("question_id", "type"), "question_id").groupBy("type")
    out = g.agg(F.count("is_correct").alias("answered"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("is_correct").isNull()).alias("pending"))
    return out.withColumn("rate", share("correct", "answered"))


def subject_rollup(snaps: DataFrame, subject: Column) -> DataFrame:
    """Reliable and weak knowledge points per user and subject."""
    g = snaps.withColumn("subject", subject).groupBy("user_id", "subject")
    return g.agg(F.count_if("reliable").alias("n_reliable"), F.count_if(F.col("reliable") & (F.col("mastery") < WEAK)).alias("weak"))


def remediation(snaps: DataFrame, gain: Column, k: int = 8) -> DataFrame:
    """The ``k`` reliable points per user with the most to gain: (1 - mastery) * weight, then answers, then name."""
    s = snaps.where("reliable").withColumn("gain", round_half_up((1 - F.col("mastery")) * gain, 4))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("gain"), F.desc("total"), "kp_id"))
    return s.withColumn("nth", nth).where(F.col("nth") <= k).select("user_id", "kp_id", "gain", "mastery", "nth")


def next_step(snaps: DataFrame, streaks: DataFrame, edges: DataFrame) -> DataFrame:
    """STUCK, UNKNOWN, PREREQ_WEAK, PREREQ_UNKNOWN or PRACTICE for each seen point; edges: kp_id, prereq_id.

    The prerequisite named is the weakest, by name where several are as weak.
    """
    p = snaps.select("user_id", F.col("kp_id").alias("prereq_id"), F.col("mastery").alias("pm"), F.col("reliable").alias("pr"))
    asked = snaps.select("user_id", "kp_id").join(edges, "kp_id").join(p, ["user_id", "prereq_id"], "left")
    pre = asked.groupBy("user_id", "kp_id").agg(
        F.min(F.when(F.col("pr") & (F.col("pm") < WEAK), F.struct("pm", "prereq_id"))).alias("weakest"), F.min(F.when(F.col("pm").isNull() | ~F.col("pr"), F.col("prereq_id"))).alias("unknown")
    )
    s = snaps.join(streaks, ["user_id", "kp_id"]).join(pre, ["user_id", "kp_id"], "left")
    step = F.when(F.col("wrong_streak") >= STUCK, "STUCK").when(~F.col("reliable"), "UNKNOWN").when(F.col("weakest").isNotNull(), "PREREQ_WEAK").when(F.col("unknown").isNotNull(), "PREREQ_UNKNOWN").otherwise("PRACTICE")
    s = s.withColumn("step", step)
    return s.select("user_id", "kp_id", "step", F.expr("case step when 'PREREQ_WEAK' then weakest.prereq_id when 'PREREQ_UNKNOWN' then unknown end").alias("prereq_id"))
