"""Registered queries on statistics, mastery, levels and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels, mastery, star, stats
from ..sources import tables as T

NOW = "2001-12-31 00:00:00"
_TOTALS = """totals AS (SELECT a.*, t.total_score, row_number() OVER (PARTITION BY assignment_id, user_id ORDER BY started_at, a.attempt_id) AS attempt_no
  FROM attempts a LEFT JOIN (SELECT attempt_id, sum(earned) AS total_score FROM answers GROUP BY 1) t ON t.attempt_id = a.attempt_id)"""
_ROWS = """recent AS (SELECT attempt_id, user_id FROM attempts WHERE status <> 'IN_PROGRESS' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, attempt_id DESC) <= 400),
graded AS (SELECT r.user_id, q.kp_id, q.type, q.difficulty, a.* FROM answers a JOIN recent r ON r.attempt_id = a.attempt_id JOIN questions q ON q.question_id = a.question_id WHERE is_correct IS NOT NULL)"""
_SNAPS = _ROWS + """,
weighed AS (SELECT *, exp(-0.001 * greatest((epoch(TIMESTAMP '2001-12-31') - epoch(answered_at)) / 86400.0, 0.0) / 7.0) * (1 + 0.6 * CASE WHEN is_correct THEN difficulty - 0.5 ELSE 0.5 - difficulty END) AS w FROM graded),
sums AS (SELECT user_id, kp_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, sum(w) AS sum_w, sum(CASE WHEN is_correct THEN w ELSE 0 END) AS sum_c, max(answered_at) AS last_answered_at FROM weighed GROUP BY 1, 2),
snaps AS (SELECT user_id, kp_id, total, correct, floor(sum_w * 10000 + 0.5) / 10000 AS evidence, floor(sum_c / (sum_w + 2) * 10000 + 0.5) / 10000 AS mastery, total >= 5 AND sum_w >= 2.5 AS reliable, last_answered_at FROM sums)"""
_STREAK = """marked AS (SELECT *, max(CASE WHEN is_correct THEN (answered_at, attempt_id, question_id) END) OVER (PARTITION BY user_id, kp_id) AS last_ok FROM graded),
streaks AS (SELECT user_id, kp_id, count(*) FILTER (last_ok IS NULL OR (answered_at, attempt_id, question_id) > last_ok) AS wrong_streak FROM marked GROUP BY 1, 2)"""
_SCORES = """scored AS (SELECT a.assignment_id, a.attempt_id, a.user_id, floor(sum(earned) * 100 + 0.5) / 100 AS total FROM attempts a JOIN answers USING (attempt_id) WHERE status <> 'IN_PROGRESS' GROUP BY 1, 2, 3 HAVING sum(earned) IS NOT NULL)"""
_TOP = """ranked AS (SELECT *, count(*) OVER (PARTITION BY assignment_id) AS n, rank() OVER (PARTITION BY assignment_id ORDER BY total DESC) AS rk FROM scored),
top AS (SELECT assignment_id, max(n) AS n, CAST(max(greatest(1, ceil(n / 100))) AS BIGINT) AS nominal, count(*) AS with_ties, avg(total) AS top_mean FROM ranked WHERE rk <= greatest(1, ceil(n / 100)) GROUP BY 1),
steps AS (SELECT assignment_id, n AS cohort, floor((top_mean / 15 + 2.220446049250313e-16) * 1e5 + 0.5) / 1e5 AS step FROM top)"""
_STAR = """best AS (SELECT * FROM wishes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY wish_rank, institution, star_group) = 1),
star AS (SELECT institution, star_group, user_id, floor(percentile * 10000 + 0.5) / 10000 AS percentile, CAST(row_number() OVER (PARTITION BY institution, star_group ORDER BY b.percentile, user_id) AS INT) AS "order",
  count(*) OVER (PARTITION BY institution, star_group, b.percentile) > 1 AS tied FROM best b)"""
_EDGES = "edges AS (SELECT kp_id, lag(kp_id) OVER (ORDER BY kp_id) AS prereq_id FROM (SELECT DISTINCT kp_id FROM questions))"


def _totals(s, d):
    return stats.with_totals(T.attempts(s, d), T.answers(s, d)).drop("pending")


def _graded(s, d):
    return mastery.graded_answers(T.attempts(s, d), T.answers(s, d), T.questions(s, d))


def _snaps(s, d):
    return mastery.snapshots(_graded(s, d), NOW)


def _scores(s, d):
    return stats.scores(T.attempts(s, d), T.answers(s, d)).drop("percentile")


def _expected(s, d):
    """Everyone of a class is expected at the assignments of class_id % 27."""
    return T.users(s, d).select("user_id", (F.lit(199501) + (F.col("class_id") % 7) * 100).cast("int").alias("assignment_id"))


def class_stats_summary(s, d):
    return stats.summary(T.attempts(s, d), T.answers(s, d))


def class_stats_questions(s, d):
    return stats.by_question(T.attempts(s, d), T.answers(s, d))


def class_stats_scores(s, d):
    return stats.scores(T.attempts(s, d), T.answers(s, d))


def class_stats_missing(s, d):
    return stats.missing(_expected(s, d), T.attempts(s, d))


def mastery_snapshots(s, d):
    return _snaps(s, d)


def wrong_streak(s, d):
    return mastery.wrong_streak(_graded(s, d))


def class_weakness(s, d):
    return mastery.class_weakness(_snaps(s, d), T.users(s, d))


def type_breakdown(s, d):
    return mastery.type_breakdown(T.answers(s, d), T.questions(s, d))


def subject_weak_rollup(s, d):
    return mastery.subject_rollup(_snaps(s, d), F.substring("kp_id", 1, 7))


def remediation_topk(s, d):
    return mastery.remediation(_snaps(s, d), F.lit(1.0))


def _edges(s, d):
    from pyspark.sql.window import Window

    k = T.questions(s, d).select("kp_id").distinct()
    return k.withColumn("prereq_id", F.lag("kp_id").over(Window.orderBy("kp_id"))).where("prereq_id is not null")


def next_step(s, d):
    return mastery.next_step(_snaps(s, d), mastery.wrong_streak(_graded(s, d)), _edges(s, d))


def gsat_levels(s, d):
    x = levels.levels(_scores(s, d), "assignment_id", "total", anchor=12.5)
    return x.select("assignment_id", "attempt_id", "method", F.col("step"), "level")


def top_one_percent(s, d):
    x = levels.top_one_percent(_scores(s, d), "assignment_id", "total")
    return x.withColumn("top_mean", F.floor(F.col("top_mean") * 100 + 0.5) / 100)


def level_table(s, d):
    x = levels.top_one_percent(_scores(s, d), "assignment_id", "total").select("assignment_id", levels.interval(F.col("top_mean")).alias("step"))
    return levels.level_table(x, "assignment_id")


def five_standards(s, d):
    return levels.five_standards(T.grade_records(s, d), "subject_code", "grade")


def star_ranking(s, d):
    return star.ranking(T.wishes(s, d))


def star_squeeze(s, d):
    return star.squeeze(star.ranking(T.wishes(s, d)))


def star_coordinator(s, d):
    return star.coordinator(star.ranking(T.wishes(s, d)))


def star_sensitivity(s, d):
    return star.sensitivity(star.ranking(T.wishes(s, d)))


def star_student_view(s, d):
    return star.student_view(star.ranking(T.wishes(s, d)))


def peer_means(s, d):
    return stats.peer_means(_totals(s, d))


def gradebook_long(s, d):
    return stats.gradebook(_totals(s, d))


def gradebook_pivot(s, d):
    return stats.gradebook_pivot(_totals(s, d), [200101, 200102, 200103])


def student_vs_peers(s, d):
    return stats.student_vs_peers(_totals(s, d))


def assignment_list_stats(s, d):
    return stats.assignment_list(_totals(s, d))


def learning_trace(s, d):
    return stats.learning_trace(T.grade_records(s, d))


NAMES = [
    class_stats_summary, class_stats_questions, class_stats_scores, class_stats_missing, mastery_snapshots, wrong_streak, class_weakness, type_breakdown, subject_weak_rollup, remediation_topk, next_step, gsat_levels,
    top_one_percent, level_table, five_standards, star_ranking, star_squeeze, star_coordinator, star_sensitivity, star_student_view, peer_means, gradebook_long, gradebook_pivot, student_vs_peers, assignment_list_stats, learning_trace,
]
QUERIES = {f.__name__: f for f in NAMES}

_A = ("attempts", "answers")
ORACLES = {
    "class_stats_summary": T.sql(
        """SELECT assignment_id, count(*) AS started, count(*) FILTER (status <> 'IN_PROGRESS') AS submitted, count(*) FILTER (status = 'GRADED') AS graded, count(*) FILTER (status = 'SUBMITTED') AS ungraded,
  floor(avg(s) * 100 + 0.5) / 100 AS mean, floor(quantile_cont(s, 0.5) * 100 + 0.5) / 100 AS median, min(s) AS lowest, max(s) AS highest
  FROM (SELECT *, CASE WHEN status <> 'IN_PROGRESS' THEN floor(total_score * 100 + 0.5) / 100 END AS s FROM totals) GROUP BY 1""", *_A, extra=_TOTALS),
    "class_stats_questions": T.sql(
        """SELECT d.assignment_id, question_id, count(*) AS answered, count(*) FILTER (is_correct) AS correct, floor(count(*) FILTER (is_correct) / any_value(n) * 100 * 10 + 0.5) / 10 AS correct_rate,
  floor(coalesce(sum(earned), 0) / (any_value(n) * max(score)) * 100 * 10 + 0.5) / 10 AS earned_rate, count(*) FILTER (is_correct IS NULL AND earned IS NULL) AS needs_review
  FROM answers a JOIN done d ON d.attempt_id = a.attempt_id GROUP BY 1, 2""", *_A,
        extra="done AS (SELECT attempt_id, assignment_id, count(*) OVER (PARTITION BY assignment_id) AS n FROM attempts WHERE status <> 'IN_PROGRESS')"),
    "class_stats_scores": T.sql("SELECT *, floor(cume_dist() OVER (PARTITION BY assignment_id ORDER BY total) * 100 * 10 + 0.5) / 10 AS percentile FROM scored", *_A, extra=_SCORES),
    "class_stats_missing": T.sql(
        "SELECT user_id, CAST(199501 + class_id % 7 * 100 AS INT) AS assignment_id FROM users u WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.user_id = u.user_id AND a.assignment_id = 199501 + class_id % 7 * 100 AND status <> 'IN_PROGRESS')", "attempts", "users"),
    "mastery_snapshots": T.sql("SELECT * FROM snaps", *_A, "questions", extra=_SNAPS),
    "wrong_streak": T.sql("SELECT * FROM streaks", *_A, "questions", extra=_ROWS + ",\n" + _STREAK),
    "class_weakness": T.sql(
        """SELECT class_id, kp_id, count(*) AS students, count(*) FILTER (reliable) AS n_reliable, count(*) FILTER (reliable AND mastery < 0.5) AS weak, floor(avg(mastery) FILTER (reliable) * 10000 + 0.5) / 10000 AS mean_mastery,
  count(*) FILTER (reliable) >= 3 AS enough FROM snaps JOIN users USING (user_id) GROUP BY 1, 2""", *_A, "questions", "users", extra=_SNAPS),
    "type_breakdown": T.sql(
        """SELECT type, count(is_correct) AS answered, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_correct IS NULL) AS pending,
  CASE WHEN count(is_correct) > 0 THEN floor(count(*) FILTER (is_correct) / count(is_correct) * 10000 + 0.5) / 10000 END AS rate FROM answers JOIN questions USING (question_id) GROUP BY 1""", "answers", "questions"),
    "subject_weak_rollup": T.sql("SELECT user_id, substring(kp_id, 1, 7) AS subject, count(*) FILTER (reliable) AS n_reliable, count(*) FILTER (reliable AND mastery < 0.5) AS weak FROM snaps GROUP BY 1, 2", *_A, "questions", extra=_SNAPS),
    "remediation_topk": T.sql(
        "SELECT * FROM (SELECT user_id, kp_id, gain, mastery, CAST(row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, total DESC, kp_id) AS INT) AS nth FROM (SELECT *, floor((1 - mastery) * 10000 + 0.5) / 10000 AS gain FROM snaps WHERE reliable)) WHERE nth <= 8", *_A, "questions", extra=_SNAPS),
    "next_step": T.sql(
        """SELECT s.user_id, s.kp_id, step, CASE step WHEN 'PREREQ_WEAK' THEN weakest WHEN 'PREREQ_UNKNOWN' THEN unknown END AS prereq_id FROM (
  SELECT s.*, p.weakest, p.unknown, CASE WHEN wrong_streak >= 3 THEN 'STUCK' WHEN NOT reliable THEN 'UNKNOWN' WHEN weakest IS NOT NULL THEN 'PREREQ_WEAK' WHEN unknown IS NOT NULL THEN 'PREREQ_UNKNOWN' ELSE 'PRACTICE' END AS step
  FROM snaps s JOIN streaks k ON k.user_id = s.user_id AND k.kp_id = s.kp_id LEFT JOIN pre p ON p.user_id = s.user_id AND p.kp_id = s.kp_id) s""", *_A, "questions",
        extra=_SNAPS + ",\n" + _STREAK + ",\n" + _EDGES + """,
pre AS (SELECT s.user_id, s.kp_id, CASE WHEN q.reliable AND q.mastery < 0.5 THEN e.prereq_id END AS weakest, CASE WHEN q.mastery IS NULL OR NOT q.reliable THEN e.prereq_id END AS unknown
  FROM snaps s JOIN edges e ON e.kp_id = s.kp_id AND e.prereq_id IS NOT NULL LEFT JOIN snaps q ON q.user_id = s.user_id AND q.kp_id = e.prereq_id)"""),
    "gsat_levels": T.sql(
        """SELECT assignment_id, attempt_id, CASE WHEN cohort >= 300 THEN 'COHORT' ELSE 'HISTORICAL_ANCHOR' END AS method, CASE WHEN cohort >= 300 THEN step ELSE 12.5 END AS step,
  CAST(CASE WHEN total <= 0 THEN 0 ELSE least(15, greatest(0, ceil(total / CASE WHEN cohort >= 300 THEN step ELSE 12.5 END - 1e-9))) END AS INT) AS level FROM scored JOIN steps USING (assignment_id)""", *_A, extra=_SCORES + ",\n" + _TOP),
    "top_one_percent": T.sql("SELECT assignment_id, n, nominal, with_ties, floor(top_mean * 100 + 0.5) / 100 AS top_mean FROM top", *_A, extra=_SCORES + ",\n" + _TOP),
    "level_table": T.sql(
        "SELECT assignment_id, CAST(level AS INT) AS level, CASE WHEN level = 0 THEN 0.0 ELSE floor((level - 1) * step * 100 + 0.5) / 100 END AS above, floor(level * step * 100 + 0.5) / 100 AS up_to FROM steps CROSS JOIN (SELECT unnest(range(16)) AS level)", *_A, extra=_SCORES + ",\n" + _TOP),
    "five_standards": T.sql(
        "SELECT subject_code, n, " + ", ".join(f"CASE WHEN n >= 300 THEN {x} END AS {x}" for x in levels.STANDARDS) + " FROM (SELECT subject_code, max(n) AS n, " + ", ".join(f"min(grade) FILTER (rn >= ceil(n * {p} / 100)) AS {x}" for x, p in levels.STANDARDS.items())
        + " FROM (SELECT *, count(*) OVER (PARTITION BY subject_code) AS n, row_number() OVER (PARTITION BY subject_code ORDER BY grade) AS rn FROM grade_records) GROUP BY 1)", "grade_records"),
    "star_ranking": T.sql('SELECT *, "order" <= 2 AS nominated, "order" = 1 AS first_round, "order" <= 2 AND star_group <= 6 AS second_round FROM star', "wishes", extra=_STAR),
    "star_squeeze": T.sql("""SELECT institution, CASE WHEN star_group <= 3 THEN '1-3' WHEN star_group <= 6 THEN '4-6' ELSE '7-8' END AS group_set, count(*) AS first_rounders FROM star WHERE "order" = 1 GROUP BY 1, 2 HAVING count(*) > 1""", "wishes", extra=_STAR),
    "star_coordinator": T.sql(
        """SELECT i.institution, CAST(g AS INT) AS star_group, count(s.user_id) AS candidates, CAST(greatest(0, 2 - count(s.user_id)) AS INT) AS unused, count(s.user_id) > 2 AS crowded, count(s.user_id) = 0 AS empty
  FROM (SELECT DISTINCT institution FROM star) i CROSS JOIN (SELECT unnest(range(1, 9)) AS g) LEFT JOIN star s ON s.institution = i.institution AND s.star_group = g GROUP BY 1, 2""", "wishes", extra=_STAR),
    "star_sensitivity": T.sql('SELECT user_id, "order", greatest("order" - 1, 1) <= 2 AS if_better, "order" + 1 <= 2 AS if_worse FROM star', "wishes", extra=_STAR),
    "star_student_view": T.sql('SELECT user_id, cohort, CASE WHEN cohort >= 3 THEN "order" END AS "order", "order" <= 2 AS nominated FROM (SELECT *, count(*) OVER (PARTITION BY institution, star_group) AS cohort FROM star)', "wishes", extra=_STAR),
    "peer_means": T.sql(
        """SELECT assignment_id, peers, CASE WHEN peers >= 5 THEN floor(m * 10 + 0.5) / 10 END AS peer_mean, CASE WHEN peers < 5 THEN 'HIDDEN' WHEN m > 137.5 THEN 'ABOVE' WHEN m < 112.5 THEN 'BELOW' ELSE 'NEAR' END AS label
  FROM (SELECT assignment_id, count(*) AS peers, avg(total_score) AS m FROM (SELECT * FROM totals WHERE total_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY assignment_id, user_id ORDER BY attempt_no DESC) = 1) GROUP BY 1)""", *_A, extra=_TOTALS),
    "gradebook_long": T.sql(
        """SELECT user_id, assignment_id, tenths / 10 AS cell, floor(sum(tenths) OVER (PARTITION BY user_id) / count(*) OVER (PARTITION BY user_id) + 0.5) / 10 AS row_mean, 12 - count(*) OVER (PARTITION BY user_id) AS missing,
  floor(sum(tenths) OVER (PARTITION BY assignment_id) / count(*) OVER (PARTITION BY assignment_id) + 0.5) / 10 AS column_mean FROM cells""", *_A, extra=_TOTALS + """,
keep AS (SELECT DISTINCT assignment_id FROM totals ORDER BY 1 DESC LIMIT 12),
cells AS (SELECT user_id, assignment_id, CAST(floor(total_score / 250 * 1000 + 0.5) AS BIGINT) AS tenths FROM totals WHERE total_score IS NOT NULL AND assignment_id IN (SELECT assignment_id FROM keep) QUALIFY row_number() OVER (PARTITION BY assignment_id, user_id ORDER BY attempt_no DESC) = 1)"""),
    "gradebook_pivot": T.sql(
        "SELECT user_id, " + ", ".join(f"max(cell) FILTER (assignment_id = {a}) AS a_{a}" for a in (200101, 200102, 200103)) + " FROM cells GROUP BY 1", *_A, extra=_TOTALS + """,
cells AS (SELECT user_id, assignment_id, floor(total_score / 250 * 100 * 10 + 0.5) / 10 AS cell FROM totals WHERE total_score IS NOT NULL AND assignment_id IN (200101, 200102, 200103) QUALIFY row_number() OVER (PARTITION BY assignment_id, user_id ORDER BY attempt_no DESC) = 1)"""),
    "student_vs_peers": T.sql(
        """SELECT user_id, count(*) AS scored, floor(avg(total_score / 250) * 100 * 10 + 0.5) / 10 AS own_mean, floor(avg(peer / 250) * 100 * 10 + 0.5) / 10 AS peer_mean FROM (
  SELECT *, avg(total_score) OVER (PARTITION BY assignment_id) AS peer, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, attempt_id DESC) AS nth FROM totals WHERE total_score IS NOT NULL) WHERE nth <= 200 GROUP BY 1""", *_A, extra=_TOTALS),
    "assignment_list_stats": T.sql(
        """SELECT assignment_id, count(*) FILTER (status <> 'IN_PROGRESS') AS submitted, count(*) FILTER (status = 'SUBMITTED') AS ungraded, count(*) FILTER (status = 'IN_PROGRESS') AS stranded, floor(avg(total_score) FILTER (status <> 'IN_PROGRESS') * 10 + 0.5) / 10 AS mean
  FROM totals WHERE assignment_id IN (SELECT DISTINCT assignment_id FROM totals ORDER BY 1 DESC LIMIT 40) GROUP BY 1""", *_A, extra=_TOTALS),
    "learning_trace": T.sql(
        """SELECT * FROM (SELECT user_id, subject_code, arg_min(grade, (exam_date, exam_name)) AS first_grade, arg_max(grade, (exam_date, exam_name)) AS last_grade, count(*) AS records FROM grade_records GROUP BY 1, 2) WHERE abs(last_grade - first_grade) >= 2""", "grade_records"),
}
