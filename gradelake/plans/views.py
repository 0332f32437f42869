"""Registered queries on counters, picks, pages and import states, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..operators import notify
from ..operators import views as V
from ..sources import tables as T
from . import core, roster
from .guards import _list, _pick, _text

NOW = "2001-06-30 12:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"
STATES = ["IN_PROGRESS", "OPEN", "UPCOMING", "DONE", "MISSED", "DONE", "DONE"]
NOTES = ["SENT", "SENT", "PENDING", "FAILED", "SUPPRESSED"]
BLOCKS = ["SECTION_HEADER", "TEXT", "EXERCISE_HEADER", "ANSWER_KEY", "GROUP_LEAD", "CONCEPT", "TEXT"]
STAGES = ["QUEUED", "READING", "SEGMENTING", "SOLVING", "READY_FOR_REVIEW", "FAILED"]
DISPLAY, LICENCE = ["FULL", "FULL", "HIDDEN", "SUMMARY_ONLY"], ["OPEN", "TENANT_NO_EXPORT", "INTERNAL_USE_ONLY", "OPEN", "OPEN"]


def _targets(s, d):
    """Each assignment is set for five of the 25 classes."""
    a = T.assignments(s, d).select("assignment_id")
    return a.withColumn("class_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("assignment_id") + i * 5) % 25).cast("int"))))


def child_summary(s, d):
    k = F.col("o_orderkey")
    t = T.scan(s, d, "orders").select(F.col("o_custkey").alias("user_id"), _pick(STATES, k).alias("state"), (k % 9 == 0).alias("late"), F.when(k % 7 > 2, F.col("o_orderdate")).alias("submitted_at"), (k % 4 > 0).alias("visible"), F.when(k % 5 > 0, F.col("o_totalprice")).alias("score"))
    return V.child_summary(t)


def class_prior_tasks(s, d):
    a = T.assignments(s, d).withColumn("allow_late", F.when(F.col("assignment_id") % 4 > 0, F.col("assignment_id") % 4 == 1))
    return V.prior_tasks(_targets(s, d), a, NOW)


def _notes(s, d):
    """Events as notices."""
    e = F.col("event_id")
    return T.scan(s, d, "events").select(e.alias("note_id"), F.col("user_id").alias("recipient_id"), _pick(NOTES, e).alias("status"), F.when(e % 3 == 0, F.col("ts")).alias("read_at"), F.col("ts").alias("created_at"))


def unread_count(s, d):
    return V.unread(_notes(s, d), EVENTS_NOW, 15)


def retention_purge(s, d):
    return V.retained(_notes(s, d), EVENTS_NOW, 10).select("note_id", "status")


def cohort_siblings(s, d):
    return V.siblings(T.assignments(s, d)).withColumn("last_due", _text("last_due"))


def _items(s, d):
    return T.scan(s, d, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 9).alias("paper_id"), F.col("p_size").alias("score"))


def question_usage_detail(s, d):
    return V.usage_detail(_items(s, d), T.assignments(s, d), T.attempts(s, d))


def proctor_report(s, d):
    """Attempts are pairs of user and day; those of every seventh user have no events."""
    e = T.proctor_events(s, d)
    a = e.select("attempt_id", F.date_format("at", "yyyyMMdd").alias("assignment_id")).distinct()
    return V.proctor_report(a, e.where("user_id % 7 > 0"))


def proctor_timelines(s, d):
    t = V.timelines(T.proctor_events(s, d), most=20)
    line = F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["type"], x["event_id"].cast("string"), x["duration_ms"].cast("string"))), ",")
    return t.select("attempt_id", F.size("events").cast("long").alias("n"), F.sha2(line, 256).alias("sha"))


def _links(s, d):
    return T.scan(s, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("kp_id"))


def ability_readiness(s, d):
    return V.readiness(T.questions(s, d).select("kp_id").distinct(), _links(s, d), T.questions(s, d), core._snaps(s, d))


def review_counters(s, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return V.review_counters(T.scan(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("job_id"), _pick(["CONFIRMED", "FLAGGED", "PENDING", "CONFIRMED"], k).alias("state")))


def _subject(kp):
    return F.substring(kp, 1, 7)


def class_ability(s, d):
    subject = F.when(F.col("assignment_id") % 3 == 0, "Brand#1").otherwise("Brand#2")
    a = T.assignments(s, d).select("assignment_id", subject.alias("subject"), F.col("open_at").alias("created_at"))
    latest = V.latest_assignments(_targets(s, d), a, 3)
    snaps = core._snaps(s, d).select("user_id", _subject("kp_id").alias("subject"))
    return V.class_ability(T.users(s, d).select("class_id", "user_id"), latest, T.attempts(s, d), T.answers(s, d).select("attempt_id", "question_id", "is_correct"), _links(s, d), snaps)


def study_plan(s, d):
    p = T.questions(s, d).select("kp_id").distinct().withColumn("weight", F.when(F.substring("kp_id", 7, 1) != "2", F.length("kp_id") * 0.25))
    return V.study_plan(core._snaps(s, d), p).withColumn("value", F.floor(F.col("value") * 1e6 + 0.5) / 1e6)


def study_plan_steps(s, d):
    """The study plan with each point's next step, prerequisites included."""
    return V.plan_steps(study_plan(s, d), core.next_step(s, d))


def best_rule(s, d):
    li = T.scan(s, d, "lineitem").select((F.col("l_partkey") % 300).alias("program"), (F.col("l_suppkey") % 6).alias("subject"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity").cast("int") % 16).alias("grade"))
    return V.best_rule(li)


def explanation_pick(s, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    c = T.scan(s, d, "lineitem").select(
        F.col("l_partkey").alias("question_id"), k.alias("explanation_id"), F.when(k % 5 == 0, F.col("l_shipdate")).alias("taken_down_at"), _pick(DISPLAY, k).alias("display"), _pick(LICENCE, k).alias("licence"), (k % 40 == 3).alias("is_primary"),
        _pick([*V.ORIGINS, "OTHER"], F.floor(k / 3)).alias("origin"), F.col("l_shipdate").alias("updated_at"), F.array(F.when(k % 8 == 1, " ").otherwise("text")).alias("layers"),
    )
    return V.pick_explanation(c)


def effective_ai_level(s, d):
    return V.ai_level(T.scan(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 50 > 0, (F.col("o_orderkey") % 4 + 1 - (F.col("o_orderkey") % 33 == 0).cast("int")).cast("int")).alias("level")))


def prediction_history(s, d):
    k = F.col("o_orderkey")
    p = T.scan(s, d, "orders").select(F.col("o_custkey").alias("user_id"), k.alias("prediction_id"), F.year("o_orderdate").alias("target_year"), F.col("o_orderdate").alias("predicted_at"), (k % 9).alias("low"), (k % 9 + k % 5).alias("high"), F.when(k % 3 > 0, k % 16).alias("actual"))
    return V.prediction_history(p, [1997, 1998])


def grading_batch_rows(s, d):
    a = T.answers(s, d)
    proposals = a.where("question_id % 4 = 0").select("attempt_id", "question_id", (F.col("attempt_id") % 10).alias("proposed"))
    layout = T.assignments(s, d).join(T.questions(s, d).where("question_id % 6 = 0"), F.col("question_id") % 5 == F.col("assignment_id") % 5).select("assignment_id", "question_id", F.lit(20.0).alias("own_score"))
    return V.batch_rows(T.attempts(s, d), a.select("attempt_id", "question_id", "score"), proposals, layout)


def page_window(s, d):
    o = T.attempts(s, d).select("attempt_id", "user_id", "status")
    return V.page(o.where("status = 'SUBMITTED'"), [F.desc("user_id"), F.asc("attempt_id")], 3)


def point_lookup(s, d):
    return V.lookup(T.attempts(s, d).select("attempt_id", "user_id", "status"), attempt_id=77)


def nested_exists(s, d):
    return V.on_assignment(T.questions(s, d).select("question_id", "kp_id"), _items(s, d), T.assignments(s, d).where("paper_id < 4"), _targets(s, d).where("class_id = 3"))


def unused_references(s, d):
    """Parts that no line item of the last year names."""
    late = T.scan(s, d, "lineitem").where("l_shipdate >= '2001-01-01'").select(F.col("l_partkey").alias("question_id"))
    return V.unused(T.questions(s, d).select("question_id", "kp_id"), late, "question_id")


def search_or_relation(s, d):
    """Customers whose name or segment, or any of whose orders' priorities, holds a term."""
    c = T.scan(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    o = T.scan(s, d, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return V.found_anywhere(c, o, "c_custkey", ["c_name", "c_mktsegment"], "o_orderpriority", "UR").select("c_custkey")


def year_filter(s, d):
    years = T.attempts(s, d).select((F.floor(F.col("assignment_id") / 100)).cast("string").alias("id")).distinct().withColumn("is_current", F.col("id") == "2000")
    o = T.scan(s, d, "orders").select("o_orderkey", _pick(["all", "1996", " 1999 ", "1066", ""], F.col("o_orderkey")).alias("raw"))
    return V.year_filter(o, "raw", years).select("o_orderkey", "year")


def snapshot_sync(s, d):
    """Derived rows per user and point: those of every third user are computed anew, without their stale points."""
    a = T.answers(s, d).join(T.attempts(s, d).select("attempt_id", "user_id"), "attempt_id").join(T.questions(s, d).select("question_id", "kp_id"), "question_id")
    rows = lambda df, name: df.groupBy("user_id", "kp_id").agg(F.count("*").alias("n"), F.lit(name).alias("made"))
    return V.sync(rows(a, "old"), rows(a.where("user_id % 3 = 0 and answered_at >= '1998-01-01'"), "new"), ["user_id", "kp_id"], ["user_id"])


def rank_import_counts(s, d):
    c = T.scan(s, d, "customer").select(F.col("c_custkey").alias("key"), F.floor("c_acctbal").cast("long").alias("value"), F.when(F.col("c_custkey") % 13 == 0, "NOT_A_NUMBER").alias("problem"))
    old = T.scan(s, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), (F.floor("c_acctbal") + (F.col("c_custkey") % 2)).cast("long").alias("value"))
    return V.import_counts(c, old, "key")


def document_stats(s, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    q = T.scan(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _pick(["PRINTED", "SOLVED", "PRINTED", "NONE"], k).alias("answer_source"), F.when(k % 3 > 0, _pick(["because", ""], k)).alias("explanation"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 3).cast("int")).alias("assets"), (F.col("l_quantity").cast("int") % 17 / 16.0).alias("confidence"))
    return V.document_stats(q)


def mode_over_pages(s, d):
    li = T.scan(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _pick(["UNKNOWN", "MATH", "", "PHYSICS", "MATH"], F.col("l_partkey")).alias("subject"))
    return V.common_value(li, "doc_id", "subject", "UNKNOWN")


def genre_detect(s, d):
    li = T.scan(s, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("doc_id"), _pick(BLOCKS, F.col("l_partkey") * F.col("l_linenumber")).alias("type"))
    return V.genre(li)


def _jobs(s, d):
    e = F.col("event_id")
    return T.scan(s, d, "events").select(e.alias("job_id"), _pick(STAGES, e).alias("status"), F.when(e % 9 > 0, F.col("ts")).alias("stage_started_at"), F.when(e % 6 > 1, _pick(STAGES, e - 1)).alias("last_stage"))


def stuck_imports(s, d):
    return V.stuck_imports(_jobs(s, d), EVENTS_NOW)


def resume_stage(s, d):
    return _jobs(s, d).select("job_id", V.next_stage("last_stage", STAGES[:5]).alias("stage"))


def payload_batch(s, d):
    e = T.proctor_events(s, d).select("user_id", "type", (F.unix_millis("at") + F.col("event_id") % 2 * 0.5).alias("at_ms"), F.when(F.col("event_id") % 4 > 0, F.col("duration_ms") * 700).alias("duration_ms"), F.col("event_id").alias("nth"))
    e = e.withColumn("now_ms", F.lit(1_705_000_000_000).cast("double"))
    return V.payload(e, "now_ms", "user_id", "at_ms", most=25)


def class_overview(s, d):
    """Per class its students with wishes and conflicts, the most conflicts first."""
    n = roster.plan_conflicts(s, d).groupBy("user_id").agg(F.count("*").alias("conflicts"))
    w = T.scan(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("wishes"))
    u = T.users(s, d).join(w, "user_id", "left").join(n, "user_id", "left").fillna(0, ["wishes", "conflicts"])
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("conflicts"), "name"))
    return u.select("class_id", "user_id", "wishes", "conflicts", place.alias("place"))


HOURS = ["22:00", "07:30", "25:00", "08:00", "13:15"]


def quiet_hours(s, d):
    e = F.col("event_id")
    x = T.scan(s, d, "events").select("event_id", F.unix_millis("ts").alias("at_ms"), notify.minute_of_day(_pick(HOURS, e)).alias("start"), notify.minute_of_day(_pick(HOURS, F.floor(e / 5))).alias("end"))
    return x.select("event_id", "start", "end", notify.quiet_end(F.col("at_ms"), F.col("start"), F.col("end")).alias("send_ms"))


def day_range(s, d):
    """Orders of the local days that a stated range spans; a day that is none leaves nothing out of neither side."""
    o = T.scan(s, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("at"), _pick(["1997-02-01", "1997-02-30", "x", "1996-12-31"], F.col("o_orderkey")).alias("first"))
    low, high = dates.day_range("first", F.lit("1997-03-31"))
    return o.select("o_orderkey", F.unix_millis(low).alias("low_ms"), ((F.col("at") >= low) & (F.col("at") < high)).alias("inside"))


NAMES = [
    quiet_hours, day_range, child_summary, class_prior_tasks, unread_count, retention_purge, cohort_siblings, question_usage_detail, proctor_report, proctor_timelines, ability_readiness, review_counters, class_ability, study_plan, study_plan_steps, best_rule, explanation_pick, effective_ai_level,
    prediction_history, grading_batch_rows, page_window, point_lookup, nested_exists, unused_references, search_or_relation, year_filter, snapshot_sync, rank_import_counts, document_stats, mode_over_pages, genre_detect, stuck_imports, resume_stage, payload_batch, class_overview,
]
QUERIES = {f.__name__: f for f in NAMES}

_N, _E = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{EVENTS_NOW}'"
_TARGETS = "targets AS (SELECT assignment_id, CAST((assignment_id + i * 5) % 25 AS INT) AS class_id FROM assignments, range(5) r(i))"
_NOTES = f"notes AS (SELECT event_id AS note_id, user_id AS recipient_id, {_list(NOTES, 'event_id')} AS status, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at, ts AS created_at FROM events)"
_K = "l_orderkey * 7 + l_linenumber"
ORACLES = {
    "quiet_hours": """WITH h AS (SELECT event_id, epoch_us(ts) // 1000 AS at_ms, ([1320, 450, NULL, 480, 795])[event_id % 5 + 1] AS s, ([1320, 450, NULL, 480, 795])[event_id // 5 % 5 + 1] AS e FROM events), m AS (SELECT *, (at_ms // 60000 + 480) % 1440 AS minute FROM h)
SELECT event_id, s AS start, e AS "end", CASE WHEN s <> e AND CASE WHEN s < e THEN minute >= s AND minute < e ELSE minute >= s OR minute < e END THEN at_ms // 60000 * 60000 + CASE WHEN (e - minute + 1440) % 1440 = 0 THEN 1440 ELSE (e - minute + 1440) % 1440 END * 60000 ELSE at_ms END AS send_ms FROM m""",
    "day_range": """WITH o AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS moment, ([TIMESTAMP '1997-01-31 16:00:00', NULL, NULL, TIMESTAMP '1996-12-30 16:00:00'])[o_orderkey % 4 + 1] AS low FROM orders)
SELECT o_orderkey, CAST(epoch_us(low) // 1000 AS BIGINT) AS low_ms, moment >= low AND moment < TIMESTAMP '1997-03-31 16:00:00' AS inside FROM o""",
    "child_summary": f"""WITH t AS (SELECT o_custkey AS user_id, {_list(STATES, 'o_orderkey')} AS state, o_orderkey % 9 = 0 AS late, o_orderkey % 7 > 2 AS sent, o_orderkey % 4 > 0 AS visible, o_orderkey % 5 > 0 AS has_score FROM orders)
SELECT user_id, count(*) AS total, count(*) FILTER (state IN ('IN_PROGRESS', 'OPEN')) AS pending, count(*) FILTER (state = 'IN_PROGRESS') AS running, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (state = 'UPCOMING') AS upcoming, count(*) FILTER (state = 'DONE') AS done,
  count(*) FILTER (state = 'MISSED') AS missed, count(*) FILTER (late) AS late, count(*) FILTER (sent AND NOT visible) AS waiting, count(*) FILTER (visible AND has_score) AS scored FROM t GROUP BY 1""",
    "class_prior_tasks": T.sql(
        f"SELECT class_id, count(*) AS total, count(*) FILTER ((open_at IS NULL OR open_at <= {_N}) AND (due_at IS NULL OR assignment_id % 4 = 1 OR due_at > {_N})) AS answerable FROM targets JOIN assignments USING (assignment_id) GROUP BY 1", "attempts", "assignments", extra=_TARGETS),
    "unread_count": f"WITH {_NOTES} SELECT recipient_id, count(*) AS unread FROM notes WHERE status = 'SENT' AND read_at IS NULL AND created_at > {_E} - INTERVAL 15 DAYS GROUP BY 1",
    "retention_purge": f"WITH {_NOTES} SELECT note_id, status FROM notes WHERE NOT (status IN ('SENT', 'SUPPRESSED', 'FAILED') AND created_at < {_E} - INTERVAL 10 DAYS)",
    "cohort_siblings": T.sql("SELECT a.assignment_id, count(*) AS others, strftime(max(b.due_at), '%Y-%m-%d %H:%M:%S') AS last_due FROM assignments a JOIN assignments b ON a.paper_id = b.paper_id AND a.assignment_id <> b.assignment_id WHERE a.policy = 'ON_DUE' GROUP BY 1", "attempts", "assignments"),
    "question_usage_detail": T.sql(
        """SELECT p_partkey AS question_id, p_partkey % 9 AS paper_id, p_size AS score, a.assignment_id, CASE WHEN a.assignment_id IS NOT NULL THEN coalesce(graded, 0) END AS graded, CASE WHEN a.assignment_id IS NOT NULL THEN coalesce(running, 0) END AS in_progress FROM part LEFT JOIN assignments a ON a.paper_id = p_partkey % 9
  LEFT JOIN (SELECT assignment_id, count(*) FILTER (status <> 'IN_PROGRESS') AS graded, count(*) FILTER (status = 'IN_PROGRESS') AS running FROM attempts GROUP BY 1) g ON g.assignment_id = a.assignment_id""", "attempts", "assignments"),
    "proctor_report": T.sql(
        "SELECT strftime(seen, '%Y%m%d') AS assignment_id, count(DISTINCT attempt_id) AS attempts, count(*) FILTER (user_id % 7 > 0) AS events, count(DISTINCT attempt_id) FILTER (user_id % 7 = 0) AS silent FROM proctor_events GROUP BY 1", "proctor_events"),
    "proctor_timelines": T.sql(
        "SELECT attempt_id, count(*) AS n, sha256(string_agg(type || ':' || event_id || ':' || duration_ms, ',' ORDER BY seen, event_id)) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY seen, event_id) AS nth FROM proctor_events) WHERE nth <= 20 GROUP BY 1", "proctor_events"),
    "ability_readiness": T.sql("SELECT (SELECT count(DISTINCT kp_id) FROM questions) AS points, (SELECT count(*) FROM questions WHERE question_id % 3 > 0) AS tagged_questions, (SELECT count(*) FROM snaps) AS snapshots", "attempts", "answers", "questions", extra=core._SNAPS),
    "review_counters": f"SELECT l_orderkey % 500 AS job_id, count(*) FILTER (({_K}) % 4 IN (0, 3)) AS confirmed, count(*) FILTER (({_K}) % 4 = 1) AS flagged FROM lineitem GROUP BY 1",
    "class_ability": T.sql(
        """, latest AS (SELECT class_id, CASE WHEN assignment_id % 3 = 0 THEN 'Brand#1' ELSE 'Brand#2' END AS subject, assignment_id FROM targets JOIN assignments USING (assignment_id)
  QUALIFY row_number() OVER (PARTITION BY class_id, assignment_id % 3 = 0 ORDER BY open_at DESC, assignment_id) <= 3),
marks AS (SELECT l.class_id, l.subject, a.question_id, a.is_correct FROM latest l JOIN users u ON u.class_id = l.class_id JOIN attempts t ON t.user_id = u.user_id AND t.assignment_id = l.assignment_id AND status <> 'IN_PROGRESS' JOIN answers a ON a.attempt_id = t.attempt_id)
SELECT class_id, subject, assignments, students, coalesce(with_data, 0) AS with_data, coalesce(questions_seen, 0) AS questions_seen, coalesce(questions_tagged, 0) AS questions_tagged, coalesce("right", 0) AS "right", coalesce(wrong, 0) AS wrong, coalesce(pending, 0) AS pending
FROM (SELECT class_id, subject, count(*) AS assignments FROM latest GROUP BY 1, 2) JOIN (SELECT class_id, count(*) AS students FROM users GROUP BY 1) USING (class_id)
LEFT JOIN (SELECT class_id, left(kp_id, 7) AS subject, count(DISTINCT user_id) AS with_data FROM snaps JOIN users USING (user_id) GROUP BY 1, 2) USING (class_id, subject)
LEFT JOIN (SELECT class_id, subject, count(DISTINCT question_id) AS questions_seen, count(DISTINCT question_id) FILTER (question_id % 3 > 0) AS questions_tagged, count(*) FILTER (is_correct) AS "right", count(*) FILTER (NOT is_correct) AS wrong, count(*) FILTER (is_correct IS NULL) AS pending FROM marks GROUP BY 1, 2) USING (class_id, subject)""",
        "attempts", "answers", "questions", "users", "assignments", extra=_TARGETS + ",\n" + core._SNAPS),
    "study_plan": T.sql(
        """SELECT user_id, kp_id, floor(value * 1e6 + 0.5) / 1e6 AS value, total, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, total DESC, kp_id) AS nth FROM (
  SELECT user_id, kp_id, total, (1 - mastery) * CASE WHEN substr(kp_id, 7, 1) <> '2' THEN length(kp_id) * 0.25::DOUBLE ELSE 1 END AS value FROM snaps WHERE reliable)) WHERE nth <= 8""", "attempts", "answers", "questions", extra=core._SNAPS),
    "best_rule": """SELECT program, subject, rule_id, grade FROM (SELECT l_partkey % 300 AS program, l_suppkey % 6 AS subject, l_orderkey * 10 + l_linenumber AS rule_id, CASE WHEN l_linenumber % 4 > 0 THEN CAST(trunc(l_quantity) AS INT) % 16 END AS grade FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY program, subject ORDER BY coalesce(grade, -1) DESC, rule_id) = 1""",
    "explanation_pick": f"""SELECT question_id, k AS explanation_id FROM (SELECT l_partkey AS question_id, k, l_shipdate, k % 40 = 3 AS first, {_list([*V.ORIGINS, 'OTHER'], 'k / 3')} AS origin FROM (SELECT *, {_K} AS k FROM lineitem) WHERE k % 5 <> 0 AND {_list(DISPLAY, 'k')} <> 'HIDDEN' AND {_list(LICENCE, 'k')} <> 'INTERNAL_USE_ONLY' AND k % 8 <> 1)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY first DESC, CASE origin {' '.join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(V.ORIGINS))} ELSE 99 END, l_shipdate DESC, k) = 1""",
    "effective_ai_level": "SELECT user_id, CASE WHEN bool_or(level IS NULL OR level < 1 OR level > 4) THEN NULL ELSE min(level) END AS level FROM (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderkey % 4 + 1 - CAST(o_orderkey % 33 = 0 AS INT) AS INT) END AS level FROM orders) GROUP BY 1",
    "prediction_history": """SELECT o_custkey AS user_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS nth, o_orderkey AS prediction_id, o_orderkey % 9 AS low, o_orderkey % 9 + o_orderkey % 5 AS high, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 16 END AS actual,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 16 BETWEEN o_orderkey % 9 AND o_orderkey % 9 + o_orderkey % 5 END AS hit FROM orders WHERE year(o_orderdate) IN (1997, 1998)""",
    "grading_batch_rows": T.sql(
        """SELECT t.assignment_id, attempt_id, question_id, CASE WHEN question_id % 6 = 0 AND question_id % 5 = assignment_id % 5 THEN 20.0::DOUBLE ELSE score END AS score, CASE WHEN question_id % 4 = 0 THEN attempt_id % 10 END AS proposed, question_id % 4 = 0 AS has_proposal
  FROM attempts t JOIN answers USING (attempt_id) WHERE status <> 'IN_PROGRESS'""", "attempts", "answers"),
    "page_window": T.sql("SELECT attempt_id, user_id, status FROM attempts WHERE status = 'SUBMITTED' ORDER BY user_id DESC, attempt_id LIMIT 41 OFFSET 80", "attempts"),
    "point_lookup": T.sql("SELECT attempt_id, user_id, status FROM attempts WHERE attempt_id = 77 LIMIT 1", "attempts"),
    "nested_exists": T.sql(
        "SELECT question_id, kp_id FROM questions WHERE EXISTS (SELECT 1 FROM assignments a WHERE a.paper_id = question_id % 9 AND a.paper_id < 4 AND EXISTS (SELECT 1 FROM targets t WHERE t.assignment_id = a.assignment_id AND class_id = 3))", "attempts", "questions", "assignments", extra=_TARGETS),
    "unused_references": T.sql("SELECT question_id, kp_id FROM questions WHERE question_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= '2001-01-01')", "questions"),
    "search_or_relation": "SELECT c_custkey FROM customer WHERE c_name ILIKE '%ur%' OR c_mktsegment ILIKE '%ur%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 40 = 0 AND o_orderpriority ILIKE '%ur%')",
    "year_filter": T.sql(
        f"SELECT o_orderkey, CASE WHEN raw = 'all' THEN NULL WHEN raw IN (SELECT CAST(assignment_id // 100 AS VARCHAR) FROM attempts) THEN raw ELSE '2000' END AS year FROM (SELECT o_orderkey, trim({_list(['all', '1996', ' 1999 ', '1066', ''], 'o_orderkey')}) AS raw FROM orders)", "attempts"),
    "snapshot_sync": T.sql(
        """SELECT user_id, kp_id, count(*) AS n, 'new' AS made FROM a WHERE user_id % 3 = 0 AND answered_at >= '1998-01-01' GROUP BY 1, 2
  UNION ALL SELECT user_id, kp_id, count(*), 'old' FROM a WHERE user_id NOT IN (SELECT user_id FROM a WHERE user_id % 3 = 0 AND answered_at >= '1998-01-01') GROUP BY 1, 2""", "attempts", "answers", "questions", extra="a AS (SELECT user_id, kp_id, answered_at FROM answers JOIN attempts USING (attempt_id) JOIN questions USING (question_id))"),
    "rank_import_counts": "SELECT CASE WHEN c_custkey % 13 = 0 THEN 'SKIPPED' WHEN c_custkey % 3 = 0 THEN 'IMPORTED' WHEN c_custkey % 2 = 0 THEN 'UNCHANGED' ELSE 'UPDATED' END AS action, count(*) AS n FROM customer GROUP BY 1",
    "document_stats": f"""SELECT l_orderkey AS doc_id, count(*) AS questions, count(*) FILTER (k % 4 IN (0, 2)) AS printed, count(*) FILTER (k % 3 > 0 AND k % 2 = 0) AS explained, count(*) FILTER (k % 3 > 0) AS with_assets, round_even(sum(CAST(trunc(l_quantity) AS INT) % 17 / 16.0::DOUBLE) / count(*), 3) AS mean_confidence FROM (SELECT *, {_K} AS k FROM lineitem) GROUP BY 1""",
    "mode_over_pages": f"""WITH v AS (SELECT l_orderkey AS doc_id, {_list(['UNKNOWN', 'MATH', '', 'PHYSICS', 'MATH'], 'l_partkey')} AS subject FROM lineitem), c AS (SELECT doc_id, subject, count(*) AS n FROM v WHERE subject NOT IN ('', 'UNKNOWN') GROUP BY 1, 2)
SELECT doc_id, coalesce(c.subject, 'UNKNOWN') AS subject FROM (SELECT DISTINCT doc_id FROM v) LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, subject) = 1) c USING (doc_id)""",
    "genre_detect": f"""SELECT doc_id, exam, sheet, CASE WHEN sheet >= 3 AND sheet > exam THEN 'worksheet' WHEN exam >= 2 AND exam >= sheet THEN 'exam' ELSE 'unknown' END AS genre FROM (SELECT l_orderkey % 2000 AS doc_id, count(*) FILTER (t IN {V.EXAM}) AS exam, count(*) FILTER (t IN {V.SHEET}) AS sheet
  FROM (SELECT l_orderkey, {_list(BLOCKS, 'l_partkey * l_linenumber')} AS t FROM lineitem) GROUP BY 1)""",
    "stuck_imports": f"""SELECT event_id AS job_id, {_list(STAGES, 'event_id')} AS status, CAST(floor((epoch_us({_E}) - epoch_us(ts)) / 6e7 + 0.5) AS BIGINT) AS stuck_minutes, CASE WHEN event_id % 6 > 1 THEN {_list(STAGES, 'event_id - 1')} END AS resume_from
  FROM events WHERE event_id % 9 > 0 AND event_id % 6 IN (1, 2, 3) AND ts < {_E} - INTERVAL 45 MINUTES""",
    "resume_stage": f"SELECT event_id AS job_id, CASE WHEN event_id % 6 > 1 THEN ({STAGES[:5]})[event_id % 6 + 1] ELSE '{STAGES[0]}' END AS stage FROM events",
    "payload_batch": T.sql(
        """SELECT user_id, place, type, CAST(least(greatest(floor(1705000000000 - (epoch_us(seen) // 1000 + event_id % 2 * 0.5::DOUBLE) + 0.5), 0), 21600000) AS BIGINT) AS offset_ms, CASE WHEN event_id % 4 > 0 THEN CAST(least(greatest(duration_ms * 700, 0), 21600000) AS BIGINT) END AS duration_ms
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS place FROM proctor_events) WHERE place <= 25""", "proctor_events"),
    "class_overview": "SELECT c_nationkey AS class_id, c_custkey AS user_id, coalesce(wishes, 0) AS wishes, coalesce(conflicts, 0) AS conflicts, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(conflicts, 0) DESC, c_name) AS INT) AS place FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS wishes FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS conflicts FROM (" + roster.ORACLES["plan_conflicts"] + ") GROUP BY 1) ON user_id = c_custkey",
}
ORACLES["study_plan_steps"] = f"SELECT p.*, n.step, n.prereq_id FROM ({ORACLES['study_plan']}) p JOIN ({core.ORACLES['next_step']}) n USING (user_id, kp_id)"
