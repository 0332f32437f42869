"""What may be done to an attempt, a question or a portfolio: verdict expressions and issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..functions.text import condensed

KNOWN = ("IN_PROGRESS", "SUBMITTED", "GRADED", "VOIDED")
MOST_MINUTES = 600


def _ts(now) -> Column:
    return F.lit(now).cast("timestamp")


def closed(expires_at, due_at, allow_late, now) -> Column:
    """Past its own end, or past the due time where late work is not allowed; a time that is not set ends nothing."""
    n = _ts(now)
    late = ~F.coalesce(col(allow_late), F.lit(False)) & (n > col(due_at))
    return F.coalesce(n > col(expires_at), F.lit(False)) | F.coalesce(late, F.lit(False))


def stranded(status, expires_at, due_at, allow_late, now) -> Column:
    return (col(status) == "IN_PROGRESS") & closed(expires_at, due_at, allow_late, now)


def may_finalize(status, expires_at, due_at, allow_late, now) -> Column:
    """OK only for a running attempt whose time is over; VOIDED, HANDED_IN, NO_END (it has no end at all) or STILL_OPEN else."""
    s = col(status)
    no_end = col(expires_at).isNull() & col(due_at).isNull()
    return F.when(s == "VOIDED", "VOIDED").when(s != "IN_PROGRESS", "HANDED_IN").when(closed(expires_at, due_at, allow_late, now), "OK").when(no_end, "NO_END").otherwise("STILL_OPEN")


def may_extend(status, expires_at, minutes) -> Column:
    """OK for a running attempt with an end and 1 to 600 whole minutes."""
    s, m = col(status), col(minutes)
    return F.when(m.isNull() | (m <= 0), "BAD_MINUTES").when(m > MOST_MINUTES, "TOO_LONG").when(s == "VOIDED", "VOIDED").when(s != "IN_PROGRESS", "HANDED_IN").when(col(expires_at).isNull(), "NO_END").otherwise("OK")


def extended(status, expires_at, minutes, now) -> tuple[Column, Column]:
    """(new end, whether a writer who was shut out can write again); null where it may not be extended."""
    n, ok = _ts(now), may_extend(status, expires_at, minutes) == "OK"
    later = col(expires_at) + F.make_dt_interval(mins=col(minutes).cast("int"))
    return F.when(ok, later), F.when(ok, (n > col(expires_at)) & (n <= later))


def may_end_now(status, expires_at, due_at, allow_late, now) -> Column:
    return F.when(col(status) != "IN_PROGRESS", "NOT_RUNNING").when(closed(expires_at, due_at, allow_late, now), "ALREADY_CLOSED").otherwise("OK")


def may_void(status) -> Column:
    return F.when(col(status) == "VOIDED", "ALREADY").when(~col(status).isin(*KNOWN), "UNKNOWN_STATUS").otherwise("OK")


def restored(status, submitted_at) -> Column:
    """The status that a voided attempt goes back to; null for others."""
    return F.when(col(status) == "VOIDED", F.when(col(submitted_at).isNull(), "IN_PROGRESS").otherwise("SUBMITTED"))


def remaining_seconds(expires_at, now) -> Column:
    """Whole seconds up to the end, begun ones included, never below 0; null without an end."""
    return F.greatest(F.lit(0), F.ceil((F.unix_micros(col(expires_at)) - F.unix_micros(_ts(now))) / 1e6)).cast("long")


#: Where the answers of a question type are stored.
FAMILIES = {"SINGLE_CHOICE": "CHOICE", "MULTI_CHOICE": "CHOICE", "TRUE_FALSE": "CHOICE", "FILL_SLOT": "SLOT", "FILL_TEXT": "TEXT", "SHORT_ANSWER": "TEXT", "ESSAY": "TEXT", "TRANSLATION": "TEXT"}


def family(kind) -> Column:
    return F.create_map(*[F.lit(x) for p in FAMILIES.items() for x in p])[col(kind)]


def may_change_type(old, new, answered) -> Column:
    """A question that was answered keeps its type within one family of stored answers."""
    return (col(old) == col(new)) | ~F.coalesce(col(answered) > 0, F.lit(False)) | family(old).eqNullSafe(family(new))


_ASSET = r"!\[\[a:([^\]\s]+)\]\]"


def publish_issues(questions: DataFrame) -> DataFrame:
    """(question_id, severity, code): why a question may not be published, or had better not be.

    questions: question_id, type, content, options array<struct<order int, content string>>, keys
    array<int>, slots array<string>, answer_text, assets array<string>, points, score, explanations.
    """
    fam, blank = family("type"), lambda c: F.trim(F.coalesce(col(c), F.lit(""))) == ""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    choice, some_keys = F.coalesce(fam == "CHOICE", F.lit(False)), size("keys") > 0
    orders = F.coalesce(F.transform("options", lambda o: o["order"]), F.array().cast("array<int>"))
    texts = F.concat(F.array(F.coalesce("content", F.lit(""))), F.coalesce(F.transform("options", lambda o: F.coalesce(o["content"], F.lit(""))), F.array().cast("array<string>")))
    wanted = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(_ASSET), F.lit(1))))
    positive = lambda c: F.coalesce(col(c) > 0, F.lit(False))
    rules = [
        ("BLOCK", "empty_content", blank("content")),
        ("BLOCK", "unknown_type", fam.isNull()),
        ("BLOCK", "too_few_options", choice & (size("options") < 2)),
        ("BLOCK", "no_answer", (choice & ~some_keys) | ((F.col("type") == "FILL_SLOT") & ~F.coalesce(F.exists("slots", lambda x: F.trim(x) != ""), F.lit(False))) | ((F.col("type") == "FILL_TEXT") & blank("answer_text"))),
        ("BLOCK", "answer_orphan", choice & some_keys & (F.size(F.array_except("keys", orders)) > 0)),
        ("BLOCK", "multi_answer_on_single", choice & (F.col("type") != "MULTI_CHOICE") & (size("keys") > 1)),
        ("BLOCK", "missing_asset", F.size(F.array_except(wanted, F.coalesce("assets", F.array().cast("array<string>")))) > 0),
        ("WARN", "no_knowledge_point", ~positive("points")),
        ("WARN", "zero_score", ~positive("score")),
        ("WARN", "no_explanation", ~positive("explanations")),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, rule in rules]))
    return questions.select("question_id", F.explode(found).alias("issue")).select("question_id", "issue.severity", "issue.code")


def retire_blockers(items: DataFrame, papers: DataFrame, assignments: DataFrame, now) -> DataFrame:
    """(question_id, kind, id): assignments that are still open, and papers that are neither handed out nor archived.

    items: question_id, paper_id; papers: paper_id, status; assignments: assignment_id, paper_id, due_at.
    """
    open_ = assignments.where(F.col("due_at").isNull() | (F.col("due_at") > _ts(now))).select("paper_id", F.lit("assignment").alias("kind"), F.col("assignment_id").alias("id"))
    idle = papers.where("status <> 'ARCHIVED'").join(assignments.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.lit("paper").alias("kind"), F.col("paper_id").alias("id"))
    return items.select("question_id", "paper_id").distinct().join(open_.unionByName(idle), "paper_id").select("question_id", "kind", "id").distinct()


#: School years by what a semester's name holds.
GRADES = [("(?i)(高一|高1|一年級|10年級|G1|H1)", "G1"), ("(?i)(高二|高2|二年級|11年級|G2|H2)", "G2"), ("(?i)(高三|高3|三年級|12年級|G3|H3)", "G3")]


def grade_year(semester) -> Column:
    """The first school year that fits a semester's name, else UNKNOWN."""
    s = F.coalesce(col(semester), F.lit(""))
    out = F.when(s.rlike(GRADES[0][0]), GRADES[0][1])
    for pattern, year in GRADES[1:]:
        out = out.when(s.rlike(pattern), year)
    return out.otherwise("UNKNOWN")


def may_add(items: DataFrame, candidates: DataFrame, most: dict[str, int]) -> DataFrame:
    """(user_id, item, ok, reason): whether a new piece would push its year newly over a quota; one that is over already is not stopped.

    items: user_id, grade_year, kind; candidates: user_id, item, grade_year, kind.  Kinds without a quota are free, and so are unknown years.
    """
    used = items.where(F.col("kind").isin(*most)).groupBy("user_id", "grade_year", "kind").agg(F.count("*").alias("used"))
    quota = F.create_map(*[F.lit(x) for p in most.items() for x in p])[F.col("kind")]
    full = F.coalesce((F.coalesce("used", F.lit(0)) == quota) & (F.col("grade_year") != "UNKNOWN"), F.lit(False))
    return candidates.join(used, ["user_id", "grade_year", "kind"], "left").select("user_id", "item", (~full).alias("ok"), F.when(full, F.concat(F.lower("kind"), F.lit("_full"))).alias("reason"))


def _runs(text: Column, n: Column) -> Column:
    """All runs of n characters of a text."""
    return F.when((n > 0) & (F.length(text) >= n), F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def quoted(text: Column) -> Column:
    """What stands in quotation marks of any kind, 1 to 60 characters each."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"{a}([^{b}]{{1,60}}){b}"), F.lit(1)) for a, b in (("「", "」"), ("『", "』"), ('"', '"'), ("“", "”"))]))


def proposal_issues(proposals: DataFrame, rubric: DataFrame, tolerance: float = 0.01, least: int = 12, most: int = 600, quote: int = 6, extreme: int = 8, span: int = 5, evidence: int = 3) -> DataFrame:
    """(proposal_id, code): where a proposed grade contradicts its rubric, itself or the answer it grades.

    proposals: proposal_id, question_id, total, rationale, answer, public (question and rubric text), dimensions
    array<struct<id string, score double, most double, reason string>>; rubric: question_id, id, max_score.
    A rationale must hold ``quote`` characters in a row of the answer that are not public (``extreme`` for no or all points), or a
    quotation of ``evidence`` characters from the answer; a quotation of ``span`` or more that stands nowhere is made up.
    A rubric has few dimensions, so it is gathered by question before the join.
    """
    r = rubric.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "max_score")))).alias("limits"), F.sum("max_score").alias("full"))
    dims = F.coalesce("dimensions", F.expr("cast(array() as array<struct<id string, score double, most double, reason string>>)"))
    p = proposals.join(r, "question_id").withColumn("dims", dims).withColumn("whole", F.concat_ws("\n", F.coalesce("rationale", F.lit("")), F.array_join(F.transform("dims", lambda x: F.coalesce(x["reason"], F.lit(""))), "\n")))
    p = p.withColumn("words", condensed("whole")).withColumn("own", condensed("answer")).withColumn("open", condensed("public"))
    p = p.withColumn("quotes", F.transform(quoted(F.col("whole")), condensed))
    total, n = F.col("total"), F.length("own")
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    limit = lambda x: F.try_element_at("limits", x["id"])
    near = lambda a, b: F.abs(a - b) <= tolerance
    any_ = lambda test: F.exists("dims", lambda x: F.coalesce(test(x), F.lit(False)))
    added = F.aggregate("dims", F.lit(0.0), lambda acc, x: acc + F.when(real(x["score"]), x["score"]).otherwise(0.0))
    ids = F.transform("dims", lambda x: x["id"])
    cites = lambda k: F.size(F.array_except(F.array_intersect(_runs(F.col("own"), F.least(F.lit(k), n)), _runs(F.col("words"), F.least(F.lit(k), n))), _runs(F.col("open"), F.least(F.lit(k), n)))) > 0
    proven = F.exists("quotes", lambda q: (F.length(q) >= evidence) & F.contains(F.col("own"), q))
    written = n > 0
    codes = {
        "BAD_SCORE": ~real(total) | any_(lambda x: limit(x).isNotNull() & ~real(x["score"])),
        "NEGATIVE_TOTAL": real(total) & (total < 0),
        "OVER_TOTAL": real(total) & (total > F.col("full") + tolerance),
        "UNKNOWN_DIMENSION": any_(lambda x: limit(x).isNull()),
        "DIM_NEGATIVE": any_(lambda x: limit(x).isNotNull() & real(x["score"]) & (x["score"] < 0)),
        "DIM_OVER_MAX": any_(lambda x: real(x["score"]) & (x["score"] > limit(x) + tolerance)),
        "DIM_MAX_MISMATCH": any_(lambda x: real(x["score"]) & real(x["most"]) & ~near(x["most"], limit(x))),
        "NO_DIM_REASON": any_(lambda x: limit(x).isNotNull() & real(x["score"]) & (F.coalesce(x["reason"], F.lit("")) == "")),
        "MISSING_DIMENSION": F.size(F.array_except(F.map_keys("limits"), ids)) > 0,
        "SUM_MISMATCH": (F.size("dims") > 0) & real(total) & ~near(F.floor(added * 100 + 0.5) / 100, total),
        "EMPTY_RATIONALE": F.length("words") < least,
        "TOO_LONG": F.length("words") > most,
        "BLANK_BUT_SCORED": ~written & real(total) & (total > 0),
        "GENERIC_RATIONALE": written & ~proven & ~cites(quote),
        "FABRICATED_QUOTE": written & F.exists("quotes", lambda q: (F.length(q) >= span) & ~F.contains(F.col("own"), q) & ~F.contains(F.col("open"), q)),
        "EXTREME_NO_REASON": written & real(total) & ((total <= 0) | (total >= F.col("full") - tolerance)) & ~proven & ~cites(extreme),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in codes.items()]))
    return p.select("proposal_id", F.explode(found).alias("code"))


def submission_checklist(users: DataFrame, programs: DataFrame, items: DataFrame, now, per_year: dict[str, int], per_program: dict[str, int]) -> DataFrame:
    """(user_id, code, ok, severity): what stands between a user and handing in; what cannot be checked yet is not ok.

    users: user_id; programs: user_id, program, mode, deadline; items: user_id, grade_year, kind, selected_for
    array<string>.  Uploads open on 30 April and daily from 9 to 21 o'clock of ``now``'s own clock.
    """
    over = lambda most: F.greatest(*[(F.count_if(F.col("kind") == k) > m).cast("int") for k, m in most.items()])
    p = programs.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("mode").isNull()).alias("no_mode"), F.count_if(F.col("mode") == "MIXED").alias("mixed"), F.count_if(F.col("deadline").isNull()).alias("no_deadline"))
    central = items.groupBy("user_id", "grade_year").agg(over(per_year).alias("o")).groupBy("user_id").agg(F.max("o").alias("central"))
    chosen = items.select("user_id", "kind", F.explode("selected_for").alias("program")).groupBy("user_id", "program").agg(over(per_program).alias("o")).groupBy("user_id").agg(F.max("o").alias("selected"))
    j = users.join(p, "user_id", "left").join(central, "user_id", "left").join(chosen, "user_id", "left")
    n, t = F.coalesce("n", F.lit(0)), _ts(now)
    rules = [
        ("WINDOW_START", "INFO", (F.month(t) * 100 + F.dayofmonth(t)) >= 430), ("WINDOW_DAILY", "WARN", F.hour(t).between(9, 20)), ("PROGRAMS_LISTED", "BLOCK", n > 0), ("MODE_CHOSEN", "BLOCK", (n > 0) & (F.col("no_mode") == 0)),
        ("MODE_NOT_MIXED", "BLOCK", (n > 0) & (F.col("mixed") == 0)), ("DEADLINE_KNOWN", "WARN", (n > 0) & (F.col("no_deadline") == 0)), ("COUNT_CENTRAL", "BLOCK", F.coalesce(F.col("central") == 0, F.lit(True))),
        ("COUNT_SELECTED", "BLOCK", ((n > 0) | F.col("selected").isNotNull()) & F.coalesce(F.col("selected") == 0, F.lit(True))),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(severity).alias("severity")) for code, severity, ok in rules]))
    return j.select("user_id", rows.alias("r")).select("user_id", "r.*")
