"""Class statistics: attempts and answers of one or many assignments.

The denominators are all finished attempts (an unanswered question counts as
wrong), and attempts of one user are not merged here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import round_half_up as r

FINISHED = ("SUBMITTED", "GRADED")
MIN_PEERS = 5


def finished(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("status").isin(*FINISHED))


def with_totals(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Attempts with total_score (null where nothing is graded yet) and attempt_no (in time order per user).

    A total is taken to nine decimals: sums of parts that arrive in another order end in another last bit, and a mean that lies halfway would follow it.
    """
    total = answers.groupBy("attempt_id").agg(F.round(F.sum("earned"), 9).alias("total_score"), F.count_if(F.col("is_correct").isNull()).alias("pending"))
    nth = Window.partitionBy("assignment_id", "user_id").orderBy("started_at", "attempt_id")
    return attempts.join(total, "attempt_id", "left").withColumn("attempt_no", F.row_number().over(nth))


def summary(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per assignment: started, submitted, graded, ungraded, mean, median, lowest and highest total."""
    t = attempts.join(answers.groupBy("attempt_id").agg(F.sum("earned").alias("total")), "attempt_id", "left")
    done = F.col("status").isin(*FINISHED)
    score = F.when(done, r("total", 2))
    return t.groupBy("assignment_id").agg(
        F.count("*").alias("started"),
        F.count_if(done).alias("submitted"),
        F.count_if(F.col("status") == "GRADED").alias("graded"),
        F.count_if(F.col("status") == "SUBMITTED").alias("ungraded"),
        r(F.avg(score), 2).alias("mean"),
        r(F.percentile(score, 0.5), 2).alias("median"),
        F.min(score).alias("lowest"),
        F.max(score).alias("highest"),
    )


def by_question(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per assignment and question: answered, correct, correct_rate, earned_rate and needs_review."""
    done = finished(attempts).select("attempt_id", "assignment_id")
    size = done.groupBy("assignment_id").agg(F.count("*").alias("n"))
    each = answers.join(done, "attempt_id").groupBy("assignment_id", "question_id").agg(
        F.count("*").alias("answered"),
        F.count_if("is_correct").alias("correct"),
        F.count_if(F.col("is_correct").isNull() & F.col("earned").isNull()).alias("needs_review"),
        F.sum("earned").alias("earned"),
        F.max("score").alias("score"),
    )
    each = each.join(size, "assignment_id")
    return each.select("assignment_id", "question_id", "answered", "correct", r(F.col("correct") / F.col("n") * 100, 1).alias("correct_rate"), r(F.coalesce("earned", F.lit(0.0)) / (F.col("n") * F.col("score")) * 100, 1).alias("earned_rate"), "needs_review")


def scores(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Finished attempts with their totals and the share of the assignment's scores that are no higher."""
    t = finished(attempts).join(answers.groupBy("attempt_id").agg(r(F.sum("earned"), 2).alias("total")), "attempt_id").where("total is not null")
    each = t.groupBy("assignment_id", "total").agg(F.count("*").alias("n"))  # the window runs over distinct totals, not over attempts
    no_higher = F.sum("n").over(Window.partitionBy("assignment_id").orderBy("total"))
    shares = each.select("assignment_id", "total", (no_higher / F.sum("n").over(Window.partitionBy("assignment_id"))).alias("share"))
    return t.join(shares, ["assignment_id", "total"]).select("assignment_id", "attempt_id", "user_id", "total", r(F.col("share") * 100, 1).alias("percentile"))


def missing(expected: DataFrame, attempts: DataFrame) -> DataFrame:
    """Expected (assignment_id, user_id) pairs without a finished attempt."""
    return expected.join(finished(attempts), ["assignment_id", "user_id"], "left_anti")


def peer_means(totals: DataFrame, min_peers: int = MIN_PEERS, band: float = 0.05, full: float = 250.0) -> DataFrame:
    """Mean of the latest attempt of each user per assignment; hidden below ``min_peers`` users."""
    last = totals.where("total_score is not null").groupBy("assignment_id", "user_id").agg(F.max_by("total_score", "attempt_no").alias("score"))
    g = last.groupBy("assignment_id").agg(F.count("*").alias("peers"), F.avg("score").alias("m"))
    shown = F.col("peers") >= min_peers
    label = F.when(~shown, "HIDDEN").when(F.col("m") > full * (0.5 + band), "ABOVE").when(F.col("m") < full * (0.5 - band), "BELOW").otherwise("NEAR")
    return g.select("assignment_id", "peers", F.when(shown, r("m", 1)).alias("peer_mean"), label.alias("label"))


def gradebook(totals: DataFrame, newest: int = 12, full: float = 250.0) -> DataFrame:
    """Long form of students x newest assignments: cell (percent, latest attempt), row mean, column mean, missing."""
    keep = totals.select("assignment_id").distinct().orderBy(F.desc("assignment_id")).limit(newest)
    t = totals.join(keep, "assignment_id", "left_semi").where("total_score is not null")
    tenths = F.floor(F.max_by("total_score", "attempt_no") / full * 1000 + 0.5)  # whole tenths, so that means do not depend on the order of sums
    cell = t.groupBy("assignment_id", "user_id").agg(tenths.alias("tenths"))
    mean = F.floor(F.sum("tenths") / F.count("*") + 0.5) / 10
    rows = cell.groupBy("user_id").agg(mean.alias("row_mean"), (F.lit(newest) - F.count("*")).alias("missing"))
    columns = cell.groupBy("assignment_id").agg(mean.alias("column_mean"))
    out = cell.join(rows, "user_id").join(columns, "assignment_id")
    return out.select("user_id", "assignment_id", (F.col("tenths") / 10).alias("cell"), "row_mean", "missing", "column_mean")


def gradebook_pivot(totals: DataFrame, assignment_ids: list[int], full: float = 250.0) -> DataFrame:
    """Wide form: one column a_<id> for each of a stated list of assignments."""
    t = totals.where("total_score is not null").where(F.col("assignment_id").isin(*assignment_ids))
    wide = t.groupBy("user_id").pivot("assignment_id", assignment_ids).agg(r(F.max_by("total_score", "attempt_no") / full * 100, 1))
    return wide.select("user_id", *[F.col(str(a)).alias(f"a_{a}") for a in assignment_ids])


def student_vs_peers(totals: DataFrame, newest: int = 200, full: float = 250.0) -> DataFrame:
    """Per user: own newest scored attempts against the mean of all scored attempts of the same assignment.

    A user's scores (at most ``newest``) are added newest first, as the window in the SQL hands them on: where a mean lies halfway, the order of adding decides.
    """
    scored = totals.where("total_score is not null")
    peer = scored.groupBy("assignment_id").agg(F.avg("total_score").alias("peer"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("attempt_id")))
    own = scored.withColumn("nth", nth).where(F.col("nth") <= newest).join(peer, "assignment_id")
    g = own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("nth", "total_score", "peer"))).alias("a"))
    mean = lambda c: r(F.aggregate("a", F.lit(0.0), lambda so, x: so + x[c] / full) / F.size("a") * 100, 1)
    return g.select("user_id", F.size("a").cast("long").alias("scored"), mean("total_score").alias("own_mean"), mean("peer").alias("peer_mean"))


def assignment_list(totals: DataFrame, limit: int = 40) -> DataFrame:
    """The newest assignments (a page of ``limit``) with submitted, ungraded, stranded and the mean."""
    page = totals.select("assignment_id").distinct().orderBy(F.desc("assignment_id")).limit(limit)
    g = totals.join(page, "assignment_id", "left_semi").groupBy("assignment_id")
    return g.agg(
        F.count_if(F.col("status").isin(*FINISHED)).alias("submitted"), F.count_if(F.col("status") == "SUBMITTED").alias("ungraded"),
        F.count_if(F.col("status") == "IN_PROGRESS").alias("stranded"), r(F.avg(F.when(F.col("status").isin(*FINISHED), F.col("total_score"))), 1).alias("mean"),
    )


def learning_trace(records: DataFrame, least: int = 2) -> DataFrame:
    """First and last grade per user and subject where they differ by ``least`` or more."""
    when = F.struct("exam_date", "exam_name")
    g = records.groupBy("user_id", "subject_code").agg(F.min_by("grade", when).alias("first_grade"), F.max_by("grade", when).alias("last_grade"), F.count("*").alias("records"))
    return g.where(F.abs(F.col("last_grade") - F.col("first_grade")) >= least)
