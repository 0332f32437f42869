"""Counters, picks and pages behind the views: grouped sums, semi and anti joins, one row picked a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import col, round_bankers
from .stats import FINISHED


def _ts(now) -> Column:
    return F.lit(now).cast("timestamp")


def child_summary(tasks: DataFrame) -> DataFrame:
    """Per user: tasks by state, pending (running or open), handed in late, waiting for release and with a visible score.

    tasks: user_id, state, late, submitted_at, visible, score.
    """
    is_ = lambda s: F.count_if(F.col("state") == s)
    return tasks.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("state").isin("IN_PROGRESS", "OPEN")).alias("pending"), is_("IN_PROGRESS").alias("running"), is_("OPEN").alias("open"), is_("UPCOMING").alias("upcoming"), is_("DONE").alias("done"), is_("MISSED").alias("missed"),
        F.count_if("late").alias("late"), F.count_if(F.col("submitted_at").isNotNull() & ~F.col("visible")).alias("waiting"), F.count_if(F.col("visible") & F.col("score").isNotNull()).alias("scored"),
    )


def prior_tasks(targets: DataFrame, assignments: DataFrame, now) -> DataFrame:
    """Per class: assignments that target it and how many of them can still be answered; assignments: open_at, due_at, allow_late."""
    n = _ts(now)
    can = (F.col("open_at").isNull() | (F.col("open_at") <= n)) & (F.col("due_at").isNull() | F.coalesce("allow_late", F.lit(False)) | (F.col("due_at") > n))
    return targets.select("class_id", "assignment_id").distinct().join(assignments.withColumn("can", can), "assignment_id").groupBy("class_id").agg(F.count("*").alias("total"), F.count_if("can").alias("answerable"))


def unread(notes: DataFrame, now, days: int = 30) -> DataFrame:
    """Per recipient: sent, unread notices of the last ``days``."""
    fresh = (F.col("status") == "SENT") & F.col("read_at").isNull() & (F.col("created_at") > _ts(now) - F.make_dt_interval(days=F.lit(days)))
    return notes.where(fresh).groupBy("recipient_id").agg(F.count("*").alias("unread"))


def retained(notes: DataFrame, now, days: int = 365) -> DataFrame:
    """What a purge leaves: settled notices (sent, suppressed, failed) of more than ``days`` go, what is stuck stays to be looked into."""
    old = (F.col("created_at") < _ts(now) - F.make_dt_interval(days=F.lit(days))) & F.col("status").isin("SENT", "SUPPRESSED", "FAILED")
    return notes.where(~F.coalesce(old, F.lit(False)))


def siblings(assignments: DataFrame, policy: str = "ON_DUE") -> DataFrame:
    """(assignment_id, others, last_due): the other assignments of the same paper, for those of one release policy."""
    a = assignments.where(F.col("policy") == policy).select("assignment_id", "paper_id")
    b = assignments.select(F.col("assignment_id").alias("other"), "paper_id", "due_at")
    j = a.join(b, "paper_id").where("other <> assignment_id")
    return j.groupBy("assignment_id").agg(F.count("*").alias("others"), F.max("due_at").alias("last_due"))


def usage_detail(items: DataFrame, assignments: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per question, paper and assignment: attempts that are finished and in progress; a paper without assignments keeps a row.

    items: question_id, paper_id, score; assignments: assignment_id, paper_id; attempts: assignment_id, status.
    """
    g = attempts.groupBy("assignment_id").agg(F.count_if(F.col("status").isin(*FINISHED)).alias("graded"), F.count_if(F.col("status") == "IN_PROGRESS").alias("in_progress"))
    zero = lambda c: F.when(F.col("assignment_id").isNotNull(), F.coalesce(c, F.lit(0))).alias(c)
    return items.join(assignments.select("assignment_id", "paper_id"), "paper_id", "left").join(g, "assignment_id", "left").select("question_id", "paper_id", "score", "assignment_id", zero("graded"), zero("in_progress"))


def proctor_report(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """Per assignment: attempts, their events, and attempts without any."""
    g = events.groupBy("attempt_id").agg(F.count("*").alias("events"))
    return attempts.join(g, "attempt_id", "left").groupBy("assignment_id").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.count_if(F.col("events").isNull()).alias("silent"))


def timelines(events: DataFrame, key: str = "attempt_id", at: str = "at", most: int = 1000) -> DataFrame:
    """Per attempt its events in time order, as one array; an attempt has at most ``most`` events where late ones are turned away."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(at, "event_id"))
    e = events.withColumn("nth", nth).where(F.col("nth") <= most)
    return e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "event_id", "type", "duration_ms"))).alias("events"))


def readiness(points: DataFrame, links: DataFrame, questions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: knowledge points, questions that any link names, and snapshots."""
    tagged = questions.join(links.select("question_id"), "question_id", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_", F.lit(1))
    return one(points, "points").join(one(tagged, "tagged_questions"), "_").join(one(snapshots, "snapshots"), "_").drop("_")


def review_counters(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("job_id").agg(F.count_if(F.col("state") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("state") == "FLAGGED").alias("flagged"))


def latest_assignments(targets: DataFrame, assignments: DataFrame, most: int = 12) -> DataFrame:
    """(class_id, subject, assignment_id): the newest ``most`` assignments of each class and subject; assignments: subject, created_at."""
    t = targets.select("class_id", "assignment_id").distinct().join(assignments, "assignment_id")
    nth = F.row_number().over(Window.partitionBy("class_id", "subject").orderBy(F.desc("created_at"), "assignment_id"))
    return t.withColumn("nth", nth).where(F.col("nth") <= most).select("class_id", "subject", "assignment_id")


def class_ability(members: DataFrame, latest: DataFrame, attempts: DataFrame, answers: DataFrame, links: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per class and subject: students, how many have a snapshot, assignments, questions seen and tagged, answers right, wrong and pending.

    members: class_id, user_id; latest: see ``latest_assignments``; snapshots: user_id, subject.
    """
    students = members.groupBy("class_id").agg(F.count("*").alias("students"))
    seen_by = members.join(snapshots.select("user_id", "subject").distinct(), "user_id").groupBy("class_id", "subject").agg(F.count("*").alias("with_data"))
    done = attempts.where(F.col("status").isin(*FINISHED)).join(members, "user_id").join(latest, ["class_id", "assignment_id"]).select("attempt_id", "class_id", "subject")
    a = answers.join(done, "attempt_id")
    marks = a.groupBy("class_id", "subject").agg(F.count_if("is_correct").alias("right"), F.count_if(~F.col("is_correct")).alias("wrong"), F.count_if(F.col("is_correct").isNull()).alias("pending"))
    each = a.select("class_id", "subject", "question_id").distinct().join(links.select("question_id", F.lit(1).alias("tag")).distinct(), "question_id", "left")
    seen = each.groupBy("class_id", "subject").agg(F.count("*").alias("questions_seen"), F.count("tag").alias("questions_tagged"))
    base = latest.groupBy("class_id", "subject").agg(F.count("*").alias("assignments")).join(students, "class_id")
    out = base.join(seen_by, ["class_id", "subject"], "left").join(seen, ["class_id", "subject"], "left").join(marks, ["class_id", "subject"], "left")
    return out.fillna(0, ["with_data", "questions_seen", "questions_tagged", "right", "wrong", "pending"])


def study_plan(snapshots: DataFrame, points: DataFrame, limit: int = 8) -> DataFrame:
    """Per user the ``limit`` reliable points of most value, (1 - mastery) * weight, then of most answers; points: kp_id, weight (null: 1)."""
    s = snapshots.where("reliable").join(points, "kp_id").withColumn("value", (1 - F.col("mastery")) * F.coalesce("weight", F.lit(1.0)))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), F.desc("total"), "kp_id"))
    return s.withColumn("nth", nth).where(F.col("nth") <= limit).select("user_id", "kp_id", "value", "total", "nth")


def plan_steps(plan: DataFrame, steps: DataFrame) -> DataFrame:
    """``plan`` (of ``study_plan``) with what to do about each point: its next step, and the prerequisite that it names; a point without a step is practised."""
    s = steps.select("user_id", "kp_id", F.col("step").alias("_step"), "prereq_id")
    return plan.join(s, ["user_id", "kp_id"], "left").withColumn("step", F.coalesce("_step", F.lit("PRACTICE"))).drop("_step")


def best_rule(rules: DataFrame) -> DataFrame:
    """Per program and subject the rule of the highest grade; one without a grade counts below all, and of equals the first."""
    g = rules.groupBy("program", "subject").agg(F.max_by(F.struct("rule_id", "grade"), F.struct(F.coalesce("grade", F.lit(-1)), -F.col("rule_id"))).alias("r"))
    return g.select("program", "subject", "r.rule_id", "r.grade")


#: Sources of an explanation, the preferred first.
ORIGINS = ["TEACHER_WRITTEN", "OFFICIAL_CEEC", "AI_GENERATED", "AI_REWRITTEN", "VERBATIM_IMPORT"]


def pick_explanation(candidates: DataFrame) -> DataFrame:
    """Per question the explanation to show: usable and with content; the primary one, else by source, else the newest.

    candidates: question_id, explanation_id, taken_down_at, display, licence, is_primary, origin, updated_at, layers array<string>.
    """
    usable = F.col("taken_down_at").isNull() & ~F.col("display").eqNullSafe("HIDDEN") & ~F.col("licence").eqNullSafe("INTERNAL_USE_ONLY") & F.coalesce(F.exists("layers", lambda x: F.trim(x) != ""), F.lit(False))
    rank = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin"))
    order = F.struct((~F.col("is_primary")).alias("a"), F.when(rank > 0, rank).otherwise(99).alias("b"), (-F.unix_micros("updated_at")).alias("c"), F.col("explanation_id").alias("d"))
    return candidates.where(usable).groupBy("question_id").agg(F.min_by("explanation_id", order).alias("explanation_id"))


def ai_level(classes: DataFrame) -> DataFrame:
    """Per user the least level of their classes; null where any level is not 1 to 4."""
    bad = F.col("level").isNull() | ~F.col("level").between(1, 4)
    return classes.groupBy("user_id").agg(F.when(~F.bool_or(bad), F.min("level")).alias("level"))


def prediction_history(predictions: DataFrame, years: list[int]) -> DataFrame:
    """Predictions for the given years, the newest first a user; ``hit`` is null until the grade is known."""
    p = predictions.where(F.col("target_year").isin(*years))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("predicted_at"), "prediction_id"))
    return p.select("user_id", nth.alias("nth"), "prediction_id", "low", "high", "actual", F.col("actual").between(F.col("low"), F.col("high")).alias("hit"))


def batch_rows(attempts: DataFrame, answers: DataFrame, proposals: DataFrame, layout: DataFrame) -> DataFrame:
    """Attempt, answer and its proposal, if any, with the layout's own score before the question's.

    answers: attempt_id, question_id, score; proposals: attempt_id, question_id, proposed; layout: assignment_id, question_id, own_score.
    """
    a = attempts.where(F.col("status").isin(*FINISHED)).select("attempt_id", "assignment_id").join(answers, "attempt_id")
    j = a.join(proposals, ["attempt_id", "question_id"], "left").join(layout, ["assignment_id", "question_id"], "left")
    return j.select("assignment_id", "attempt_id", "question_id", F.coalesce("own_score", "score").alias("score"), "proposed", F.col("proposed").isNotNull().alias("has_proposal"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 40) -> DataFrame:
    """Page ``number`` (from 1) and one row more, which tells whether there is a next page."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size + 1)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """At most one row with the given key values."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df.limit(1)


def on_assignment(questions: DataFrame, items: DataFrame, assignments: DataFrame, targets: DataFrame) -> DataFrame:
    """Questions on any paper that any assignment uses which any class has: EXISTS, three levels deep."""
    given = assignments.join(targets.select("assignment_id"), "assignment_id", "left_semi")
    used = items.join(given.select("paper_id"), "paper_id", "left_semi")
    return questions.join(used.select("question_id"), "question_id", "left_semi")


def unused(references: DataFrame, users: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """References that nothing uses."""
    return references.join(users, on, "left_anti")


def found_anywhere(items: DataFrame, parts: DataFrame, key: str, texts: list[str], part_text: str, term: str) -> DataFrame:
    """Items whose own texts, or any of whose parts, hold a term in any case; % and _ stand for themselves."""
    pattern = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    own = F.lit(False)
    for t in texts:
        own = own | F.coalesce(F.col(t).ilike(pattern), F.lit(False))
    hits = items.where(own).select(key).union(parts.where(F.col(part_text).ilike(pattern)).select(key)).distinct()
    return items.join(hits, key, "left_semi")


def year_filter(requests: DataFrame, raw: str, years: DataFrame) -> DataFrame:
    """``requests`` with ``year``: ``all`` is no year (null), a known id is itself, anything else the current year.

    years: id, is_current; one row a school year, so the known ids are gathered into one small row.
    """
    known = years.agg(F.collect_set("id").alias("_ids"), F.max(F.when(F.col("is_current"), F.col("id"))).alias("_current")).withColumn("_one", F.lit(1))
    term = F.trim(F.coalesce(F.col(raw), F.lit("")))
    year = F.when(term == "all", None).when(F.array_contains("_ids", term), term).otherwise(F.col("_current"))
    return requests.withColumn("_one", F.lit(1)).join(F.broadcast(known), "_one").withColumn("year", year).drop("_one", "_ids", "_current")


def sync(old: DataFrame, new: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Replaces what was derived before: new rows, and old rows of scopes that were not computed anew; stale keys of computed scopes go."""
    return new.unionByName(old.join(new.select(*scope).distinct(), scope, "left_anti"))


def import_counts(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """What an import does: per action (IMPORTED, UPDATED, UNCHANGED, SKIPPED) how many rows; rows: key, value, problem; existing: key, value."""
    j = rows.join(existing.select(key, F.col("value").alias("_old"), F.lit(True).alias("_known")), key, "left")
    action = F.when(F.col("problem").isNotNull(), "SKIPPED").when(F.col("_known").isNull(), "IMPORTED").when(F.col("_old").eqNullSafe(F.col("value")), "UNCHANGED").otherwise("UPDATED")
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def document_stats(questions: DataFrame) -> DataFrame:
    """Per document: questions, with a printed answer, an explanation or assets, and the mean confidence (half to even, 3 places)."""
    q = questions.groupBy("doc_id").agg(
        F.count("*").alias("questions"), F.count_if(F.col("answer_source") == "PRINTED").alias("printed"), F.count_if(F.coalesce(F.col("explanation"), F.lit("")) != "").alias("explained"), F.count_if(F.coalesce(F.size("assets"), F.lit(0)) > 0).alias("with_assets"),
        (F.sum("confidence") / F.count("*")).alias("mean"),
    )
    return q.withColumn("mean_confidence", round_bankers("mean", 3)).drop("mean")


def common_value(pages: DataFrame, key: str, value: str, default) -> DataFrame:
    """Per document the most frequent value over its pages that is not the default, the least of equals; the default if there is none."""
    real = F.when(F.col(value).isNotNull() & (F.col(value) != F.lit("")) & (F.col(value) != default), F.col(value))
    counts = pages.groupBy(key, real.alias("v")).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), "v"))).alias("v"))
    return top.select(key, F.coalesce("v", F.lit(default)).alias(value))


#: Kinds of blocks that mark an exam and a worksheet.
EXAM, SHEET = ("SECTION_HEADER", "SECTION_NOTE", "GROUP_LEAD"), ("EXERCISE_HEADER", "ANSWER_KEY", "CONCEPT")


def genre(blocks: DataFrame) -> DataFrame:
    """Per document: worksheet (three marks or more, and more than of an exam), exam (two or more, no fewer than of a worksheet) or unknown."""
    g = blocks.groupBy("doc_id").agg(F.count_if(F.col("type").isin(*EXAM)).alias("exam"), F.count_if(F.col("type").isin(*SHEET)).alias("sheet"))
    kind = F.when((F.col("sheet") >= 3) & (F.col("sheet") > F.col("exam")), "worksheet").when((F.col("exam") >= 2) & (F.col("exam") >= F.col("sheet")), "exam").otherwise("unknown")
    return g.select("doc_id", "exam", "sheet", kind.alias("genre"))


IDLE = ("QUEUED", "READY_FOR_REVIEW", "COMMITTED", "FAILED")


def stuck_imports(jobs: DataFrame, now, minutes: int = 45) -> DataFrame:
    """Jobs whose stage began more than ``minutes`` ago and is not an idle one: (job_id, status, stuck_minutes, resume_from)."""
    n = _ts(now)
    old = F.col("stage_started_at") < n - F.make_dt_interval(mins=F.lit(minutes))
    age = F.floor((F.unix_micros(n) - F.unix_micros("stage_started_at")) / 6e7 + 0.5)
    return jobs.where(~F.col("status").isin(*IDLE) & old).select("job_id", "status", age.cast("long").alias("stuck_minutes"), F.col("last_stage").alias("resume_from"))


def next_stage(last_stage, stages: list[str]) -> Column:
    """The stage to go on with: the one after the last that was completed, the first if there is none, null after the end."""
    at = F.array_position(F.array(*[F.lit(x) for x in stages]), F.coalesce(col(last_stage), F.lit("")))
    return F.get(F.array(*[F.lit(x) for x in stages]), at.cast("int"))


def payload(records: DataFrame, now_ms: str, key: str, at: str, most: int = 40, horizon_ms: int = 21_600_000) -> DataFrame:
    """The first ``most`` records of each sender, times as offsets before ``now_ms`` within the horizon, durations clamped likewise."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("nth"))
    clamp = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(horizon_ms)).cast("long")
    r = records.withColumn("place", nth).where(F.col("place") <= most)
    return r.select(key, "place", "type", clamp(F.col(now_ms) - F.col(at)).alias("offset_ms"), F.when(F.col("duration_ms").isNotNull(), clamp(F.col("duration_ms"))).alias("duration_ms"))
