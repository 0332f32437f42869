"""Who belongs, who has handed in, who may see what: joins and state machines over attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import FINISHED


def recipients(class_targets: DataFrame, named: DataFrame, members: DataFrame, active: DataFrame) -> DataFrame:
    """(assignment_id, user_id): members of targeted classes and named users, once each, active ones only."""
    by_class = class_targets.join(members.select("class_id", "user_id"), "class_id").select("assignment_id", "user_id")
    return by_class.unionByName(named.select("assignment_id", "user_id")).distinct().join(active.select("user_id"), "user_id", "left_semi").select("assignment_id", "user_id")


def tally(expected: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per assignment: distinct users expected, started, submitted, in progress, untouched, and strangers."""
    a = attempts.groupBy("assignment_id", "user_id").agg(F.max(F.col("status").isin(*FINISHED)).alias("done"))
    j = expected.withColumn("due", F.lit(True)).join(a, ["assignment_id", "user_id"], "full")
    due, seen = F.col("due").isNotNull(), F.col("done").isNotNull()
    return j.groupBy("assignment_id").agg(
        F.count_if(due).alias("expected"), F.count_if(due & seen).alias("started"), F.count_if(due & F.col("done")).alias("submitted"), F.count_if(due & ~F.col("done")).alias("in_progress"),
        F.count_if(due & ~seen).alias("untouched"), F.count_if(~due).alias("strangers"),
    )


def pick(attempts: DataFrame) -> DataFrame:
    """One attempt per (assignment, user): an open one, else the last finished, else the last."""
    rank = F.when(F.col("status") == "IN_PROGRESS", 0).when(F.col("status").isin(*FINISHED), 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("assignment_id", "user_id").orderBy(rank, F.desc("started_at"), F.desc("attempt_id")))
    return attempts.withColumn("nth", nth).where("nth = 1").select("assignment_id", "user_id", "attempt_id", "status")


def overdue(expected: DataFrame, attempts: DataFrame, due: DataFrame, now, days: int = 3) -> DataFrame:
    """Expected users without a finished attempt whose assignment fell due within the last ``days``."""
    n = F.lit(now).cast("timestamp")
    late = due.where((F.col("due_at") <= n) & (F.col("due_at") > n - F.expr(f"INTERVAL {days} DAYS")))
    return expected.join(late, "assignment_id").join(attempts.where(F.col("status").isin(*FINISHED)), ["assignment_id", "user_id"], "left_anti").select("assignment_id", "user_id")


def due_soon_digest(expected: DataFrame, attempts: DataFrame, due: DataFrame, now, hours: int = 24, busy: int = 20, sitting_hours: int = 2) -> DataFrame:
    """Per user the assignments that fall due within ``hours`` and are not handed in.

    Nobody is told while ``busy`` or more attempts that began within ``sitting_hours`` are open.
    """
    n = F.lit(now).cast("timestamp")
    soon = due.where((F.col("due_at") > n) & (F.col("due_at") <= n + F.expr(f"INTERVAL {hours} HOURS")))
    left = expected.join(soon, "assignment_id").join(attempts.where(F.col("status").isin(*FINISHED)), ["assignment_id", "user_id"], "left_anti")
    g = left.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("assignment_id").cast("string"))), ",").alias("assignments"))
    sitting = attempts.where((F.col("status") == "IN_PROGRESS") & F.col("started_at").between(n - F.expr(f"INTERVAL {sitting_hours} HOURS"), n))
    calm = sitting.agg(F.count("*").alias("sitting")).where(F.col("sitting") < busy).select(F.lit(True).alias("calm"))  # one row or none
    return g.withColumn("calm", F.lit(True)).join(F.broadcast(calm), "calm", "left_semi").select("user_id", "n", "assignments")


def scope(items: DataFrame, taught: DataFrame, user_id, role: str, subject: str = "subject", owner: str = "created_by") -> DataFrame:
    """An admin sees all, a teacher what they teach or made, others what they made."""
    if role == "ADMIN":
        return items
    own = items.where(F.col(owner) == user_id)
    if role != "TEACHER":
        return own
    mine = taught.where(F.col("user_id") == user_id).select(F.col("subject").alias("_s")).distinct()
    return items.join(mine, F.col(subject) == F.col("_s"), "left_semi").unionByName(own).distinct()


def cohort_gate(assignments: DataFrame, now) -> DataFrame:
    """Per assignment, over all of its paper: unbounded (another has no due time), due_at (the latest still ahead, or its own) and blocked_by (how many others).

    The sums per paper come from one grouped pass; an assignment's own part is taken out again, so no pair of assignments is formed.
    """
    n = F.lit(now).cast("timestamp")
    ahead = F.col("due_at") > n
    g = assignments.groupBy("paper_id").agg(F.count_if(F.col("due_at").isNull()).alias("open_ended"), F.count_if(ahead).alias("ahead"), F.max(F.when(ahead, F.col("due_at"))).alias("last"))
    j = assignments.join(g, "paper_id")
    own_open, own_ahead = F.col("due_at").isNull().cast("int"), F.coalesce(ahead.cast("int"), F.lit(0))
    unbounded = F.col("open_ended") - own_open > 0
    return j.select("assignment_id", unbounded.alias("unbounded"), F.when(~unbounded, F.greatest("due_at", "last")).alias("due_at"), (F.col("open_ended") - own_open + F.col("ahead") - own_ahead).alias("blocked_by"))


def visibility(policy: Column, status: Column, due_at: Column, released_at: Column, now) -> Column:
    """NONE, SCORE_ONLY or FULL.  Exactly at the due time is still SCORE_ONLY, and so is a policy of a due time without one."""
    n = F.lit(now).cast("timestamp")
    return (
        F.when((status == "VOIDED") | (policy == "NEVER") | ~status.isin(*FINISHED), "NONE")
        .when(policy.isin("IMMEDIATE", "ON_SUBMIT"), "FULL")
        .when(policy == "ON_DUE", F.when(due_at < n, "FULL").otherwise("SCORE_ONLY"))
        .when(policy == "MANUAL", F.when(released_at <= n, "FULL").otherwise("NONE"))
        .otherwise("NONE")
    )


def task_states(expected: DataFrame, attempts: DataFrame, windows: DataFrame, now) -> DataFrame:
    """Per expected (assignment, user): IN_PROGRESS, DONE, UPCOMING, MISSED or OPEN, attempts used, last submission."""
    n = F.lit(now).cast("timestamp")
    a = attempts.where("status <> 'VOIDED'").groupBy("assignment_id", "user_id").agg(F.count("*").alias("used"), F.bool_or(F.col("status") == "IN_PROGRESS").alias("open"), F.max(F.when(F.col("status").isin(*FINISHED), F.col("started_at"))).alias("last_submitted"))
    j = expected.join(windows, "assignment_id").join(a, ["assignment_id", "user_id"], "left")
    state = F.when(F.col("open"), "IN_PROGRESS").when(F.col("last_submitted").isNotNull(), "DONE").when(F.col("open_at") > n, "UPCOMING").when(F.col("due_at") <= n, "MISSED").otherwise("OPEN")
    return j.select("assignment_id", "user_id", state.alias("state"), F.coalesce("used", F.lit(0)).alias("used"), "last_submitted")


def keyset_page(df: DataFrame, before: tuple | None, order: list[str], size: int = 40) -> DataFrame:
    """The page after a key, newest first, with one row more to tell whether there is a next page."""
    if before is not None:
        key = F.struct(*order)
        df = df.where(key < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, before, strict=True)]))
    return df.orderBy(*[F.desc(c) for c in order]).limit(size + 1)


def effective_members(memberships: DataFrame, end_date, now) -> DataFrame:
    """Closing a year: open memberships get left_at = the earlier of the end date and now."""
    end = F.least(F.lit(end_date).cast("timestamp"), F.lit(now).cast("timestamp"))
    return memberships.withColumn("left_at", F.coalesce("left_at", end))


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for every rule that is false; a rule that is unknown does not count, as in a CHECK."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: of all rows of a key the one of greatest version, new rows before old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*old.columns)


#: Variants that institution names are folded over.
_FOLD = [("臺", "台"), ("國立", ""), ("私立", "")]


def folded_name(name: Column) -> Column:
    """A name without spaces, 國立 and 私立, and with 台 for 臺; an empty one never joins (null)."""
    out = F.regexp_replace(name, r"[\s\x{3000}]+", "")
    for a, b in _FOLD:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(out != "", out)


def match_references(wishes: DataFrame, references: DataFrame) -> DataFrame:
    """References that apply to a wish: same folded institution, and group and program equal or not stated."""
    w = wishes.withColumn("_k", folded_name(F.col("institution")))
    r = references.withColumn("_k", folded_name(F.col("institution"))).select("_k", F.col("star_group").alias("ref_group"), F.col("program").alias("ref_program"), "threshold")
    return w.join(r, "_k").where("(ref_group is null or ref_group = star_group) and (ref_program is null or ref_program = program)").drop("_k")


def in_stroke_order(rows: DataFrame, group: str, *by: str, tie: str) -> DataFrame:
    """``rows`` with ``position`` in their group, by names as a Traditional Chinese reader sorts them (strokes; null names first as empty)."""
    keys = [F.collate(F.coalesce(c, F.lit("")), "zh_Hant") for c in by]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*keys, tie)))


def classes_of_name(rows: DataFrame, name: str, *group: str) -> DataFrame:
    """How many rows share a name but for case and width of letters, by a collated grouping key; the least spelling stands for all."""
    key = F.collate(F.col(name), "UNICODE_CI")
    return rows.groupBy(*group, key.alias("_key")).agg(F.min(F.collate(F.col(name), "UTF8_BINARY")).alias(name), F.count("*").alias("n")).drop("_key")
