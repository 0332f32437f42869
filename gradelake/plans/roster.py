"""Registered queries on rosters, visibility, admission rules, imports and usage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import one_decimal
from ..operators import admission, roster
from ..sources import tables as T

NOW = "2001-06-30 12:00:00"
LATER = "2001-07-02 00:00:00"


def _pick(names, by):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))


def _class_targets(s, d):
    """Each assignment is set for five of the 25 classes."""
    a = T.assignments(s, d).select("assignment_id")
    return a.withColumn("class_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("assignment_id") + i * 5) % 25).cast("int"))))


def _expected(s, d):
    users = T.users(s, d)
    named = T.scan(s, d, "orders").where("o_orderpriority like '1%'").select("o_custkey", "o_orderdate")
    named = named.select((F.year("o_orderdate") * 100 + F.quarter("o_orderdate")).alias("assignment_id"), F.col("o_custkey").alias("user_id"))
    return roster.recipients(_class_targets(s, d), named, users, users.where("balance > 0"))


def recipients(s, d):
    return _expected(s, d)


def roster_tally(s, d):
    return roster.tally(_expected(s, d), T.attempts(s, d))


def roster_pick(s, d):
    return roster.pick(T.attempts(s, d))


def overdue_antijoin(s, d):
    return roster.overdue(_expected(s, d), T.attempts(s, d), T.assignments(s, d), LATER)


def due_soon_digest(s, d):
    return roster.due_soon_digest(_expected(s, d), T.attempts(s, d), T.assignments(s, d), NOW)


def _items(s, d):
    q = T.questions(s, d)
    return q.select("question_id", F.col("kp_id").alias("subject"), (F.col("question_id") % 30).alias("created_by"))


def scope_semijoin(s, d):
    taught = T.scan(s, d, "supplier").select((F.col("s_suppkey") % 30).alias("user_id"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("subject"))
    return roster.scope(_items(s, d), taught, 7, "TEACHER")


def cohort_gate(s, d):
    return roster.cohort_gate(T.assignments(s, d), NOW).withColumn("due_at", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss"))


def task_state(s, d):
    x = roster.task_states(_expected(s, d), T.attempts(s, d), T.assignments(s, d), NOW)
    return x.withColumn("last_submitted", F.date_format("last_submitted", "yyyy-MM-dd HH:mm:ss"))


def result_visibility(s, d):
    a = T.assignments(s, d)
    gate = roster.cohort_gate(a, NOW).select("assignment_id", F.col("due_at").alias("gate"))
    j = T.attempts(s, d).join(a.select("assignment_id", "policy", "released_at"), "assignment_id").join(gate, "assignment_id")
    return j.select("attempt_id", roster.visibility(F.col("policy"), F.col("status"), F.col("gate"), F.col("released_at"), NOW).alias("level"))


def keyset_page(s, d):
    return roster.keyset_page(T.attempts(s, d).select("attempt_id", "user_id", "price"), (250000.0, 0), ["price", "attempt_id"])


def class_consent_counts(s, d):
    u = T.users(s, d)
    g = u.groupBy("class_id").agg(F.count_if(F.col("balance") > 0).alias("active"), F.count_if(F.col("balance") <= 0).alias("waiting"), F.countDistinct("segment").alias("segments"))
    return g.join(T.classes(s, d), "class_id").select("class_name", "active", "waiting", "segments")


def tenant_dashboard(s, d):
    """One row a tenant: students, attempts by state and classes without any attempt."""
    u = T.users(s, d).join(T.classes(s, d), "class_id")
    a = T.attempts(s, d).join(u.select("user_id", "tenant_id", "class_id"), "user_id")
    g = a.groupBy("tenant_id").agg(*[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("IN_PROGRESS", "SUBMITTED", "GRADED")], F.countDistinct("class_id").alias("busy_classes"))
    return u.groupBy("tenant_id").agg(F.count("*").alias("students"), F.count_if(F.col("balance") <= 0).alias("waiting")).join(g, "tenant_id", "left")


def tenant_scope(s, d):
    """Attempts of one tenant, through the users that belong to it."""
    u = T.users(s, d).join(T.classes(s, d), "class_id").select("user_id", "tenant_id")
    return T.for_tenant_through(T.attempts(s, d).select("attempt_id", "user_id", "status"), u, "user_id", 2)


def upsert_latest(s, d):
    """The latest price per user and status: old rows are orders before 2000, new ones the rest."""
    o = T.attempts(s, d).select("user_id", "status", F.struct("started_at", "attempt_id").alias("version"), "attempt_id", "price")
    out = roster.upsert_latest(o.where("version.started_at < '2000-01-01'"), o.where("version.started_at >= '2000-01-01'"), ["user_id", "status"], "version")
    return out.select("user_id", "status", "attempt_id", "price")


def expectations_violations(s, d):
    o = T.scan(s, d, "lineitem")
    rules = {"discount_low": F.col("l_discount") <= 0.09, "quantity_positive": F.col("l_quantity") > 1, "price_matches": F.col("l_extendedprice") >= F.col("l_quantity") * 950}
    return roster.violations(o, rules, "l_orderkey").groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("keys"))


def _profiles(s, d):
    c = T.scan(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_nationkey")
    bit = lambda n, m: F.col("k") % n == m
    return c.select(
        F.col("k").alias("user_id"), bit(7, 1).alias("special_admitted"), bit(2, 1).alias("special_waived"), bit(11, 3).alias("is_repeater"), F.when(~bit(13, 5), ~bit(9, 4)).alias("same_school_all"),
        _pick(["NONE", "GROUP_1_7", "GROUP_8"], F.col("c_nationkey")).alias("star_category"), (F.col("c_acctbal") > 5000).alias("star_waived"), bit(5, 2).alias("apply_admitted"), bit(3, 1).alias("apply_waived"),
    )


def eligibility_rules(s, d):
    return admission.eligibility(_profiles(s, d))


def plan_conflicts(s, d):
    o = T.scan(s, d, "orders")
    w = o.select(F.col("o_custkey").alias("user_id"), _pick(["STAR", "APPLY", "APPLY", "PLACEMENT", "SPECIAL"], F.col("o_orderkey")).alias("channel"), (F.col("o_orderkey") % 50).cast("string").alias("institution"), (F.col("o_orderkey") % 8 + 1).cast("int").alias("star_group"))
    return admission.conflicts(_profiles(s, d), w)


def _portfolio(s, d):
    li = T.scan(s, d, "lineitem")
    programs = F.transform(F.sequence(F.lit(0), F.col("l_linenumber") % 3), lambda i: F.concat(F.lit("P"), ((F.col("l_partkey") + i * 7) % 5).cast("string")))
    return li.select((F.col("l_suppkey")).alias("user_id"), F.year("l_shipdate").alias("grade_year"), _pick(["OUTCOME", "DIVERSE", "SUMMARY"], F.col("l_linenumber")).alias("kind"), programs.alias("selected_for"))


def portfolio_upload_counts(s, d):
    return admission.upload_counts(_portfolio(s, d), {"OUTCOME": 60, "DIVERSE": 30})


def portfolio_selected_counts(s, d):
    p = T.scan(s, d, "supplier").select(F.col("s_suppkey").alias("user_id")).withColumn("program", F.explode(F.array(*[F.lit(f"P{i}") for i in range(7)])))
    return admission.selected_counts(_portfolio(s, d), p)


def monthly_tokens(s, d):
    e = T.scan(s, d, "events").join(T.users(s, d).join(T.classes(s, d), "class_id").select("user_id", "tenant_id"), "user_id")
    return admission.monthly_tokens(e.select("tenant_id", F.col("ts").alias("at"), (F.col("value") * 100).cast("long").alias("tokens")), price=3.0)


def rank_import(s, d):
    c = T.scan(s, d, "customer")
    full = F.translate(one_decimal(F.col("c_acctbal") / 100), "0123456789.", "０１２３４５６７８９．")
    raw = F.when(F.col("c_custkey") % 3 == 0, full).when(F.col("c_custkey") % 3 == 1, F.concat(one_decimal(F.col("c_acctbal") / 100), F.lit("%"))).when(F.col("c_custkey") % 11 == 5, "n/a").otherwise(one_decimal(F.col("c_acctbal") / 50))
    name = F.when(F.col("c_custkey") % 17 == 3, "").otherwise(F.concat(F.lit("u"), F.floor(F.col("c_custkey") / 2).cast("string")))
    return admission.rank_rows(c.select(F.col("c_custkey").alias("line"), name.alias("username"), raw.alias("percentile"), F.when(F.col("c_custkey") % 4 == 0, "4").alias("semesters")))


def roster_plan(s, d):
    c = T.scan(s, d, "customer")
    rows = c.select(F.concat(F.lit("u"), F.floor(F.col("c_custkey") / F.when(F.col("c_custkey") % 50 == 1, 2).otherwise(1)).cast("string")).alias("username"), F.when(F.col("c_custkey") % 9 == 0, " ").when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))
    users = c.where("c_nationkey < 20").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"), F.col("c_name").alias("name"))
    return admission.roster_plan(rows, users)


def fuzzy_names(s, d):
    """Institution names that are equal once folded, with references for one group, one program or all."""
    w = T.wishes(s, d).select("user_id", F.concat(F.lit("國立 臺"), "institution").alias("institution"), "star_group", "wish_rank", (F.col("user_id") % 3).cast("string").alias("program"))
    n = T.classes(s, d)
    r = n.select(F.concat(F.lit("台"), "class_name").alias("institution"), F.when(F.col("class_id") % 2 == 0, (F.col("class_id") % 8 + 1).cast("int")).alias("star_group"), F.when(F.col("class_id") % 3 == 0, F.lit("1")).alias("program"), F.col("class_id").alias("threshold"))
    return roster.match_references(w, r).select("user_id", "wish_rank", "threshold")


def tutor_digest(s, d):
    """The newest 300 sessions: turns, turns of each role, longest turn and whether the assistant had the last word."""
    c = T.scan(s, d, "conversations")
    newest = c.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(300)
    g = c.join(newest, "conv_id", "left_semi").groupBy("conv_id")
    return g.agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"), F.max(F.length("text")).cast("long").alias("longest"), (F.max_by("role", "turn") == "assistant").alias("closed"))


def close_year(s, d):
    m = T.attempts(s, d).select("attempt_id", F.when(F.col("status") == "GRADED", F.col("started_at")).alias("left_at"))
    return roster.effective_members(m, "2001-01-31 00:00:00", NOW).select("attempt_id", F.date_format("left_at", "yyyy-MM-dd").alias("left_at"))


def search_filter(s, d):
    """Line items of one quarter of attempts whose part name contains a term, whatever its case."""
    from ..functions.text import like_literal

    p = T.scan(s, d, "part").where(like_literal("p_name", "BLUE")).select("p_partkey", "p_name")
    li = T.scan(s, d, "lineitem").where("l_shipdate >= '2000-01-01' and l_shipdate < '2000-04-01'")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_name").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


#: Class names and given names to sort.
CLASS_NAMES = ["甲班", "乙班", "丙班", "一年三班", "龍班", "安班", "三年一班", "Beta", "alpha", "忠班"]
GIVEN = ["王", "丁", "林", "一", "龔", "陳", "安", "Li", "ang", "欒"]


def roster_by_strokes(s, d):
    """Customers of a nation by class and name in stroke order."""
    c = T.scan(s, d, "customer").select("c_nationkey", "c_custkey", _pick(CLASS_NAMES, F.col("c_custkey")).alias("class"), F.concat(_pick(GIVEN, F.floor(F.col("c_custkey") / 3)), _pick(GIVEN, F.floor(F.col("c_custkey") / 7))).alias("name"))
    return roster.in_stroke_order(c, "c_nationkey", "class", "name", tie="c_custkey").select("c_custkey", "c_nationkey", "position")


def names_by_letters(s, d):
    """Names that differ in case alone are one, by a collated key."""
    c = T.scan(s, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.upper(_pick(CLASS_NAMES, F.col("c_custkey")))).otherwise(_pick(CLASS_NAMES, F.col("c_custkey"))).alias("name"))
    return roster.classes_of_name(c, "name", "c_nationkey")


NAMES = [
    roster_by_strokes, names_by_letters,
    recipients, roster_tally, roster_pick, overdue_antijoin, due_soon_digest, scope_semijoin, cohort_gate, task_state, result_visibility, keyset_page, class_consent_counts, tenant_dashboard, tenant_scope, upsert_latest, expectations_violations,
    eligibility_rules, plan_conflicts, portfolio_upload_counts, portfolio_selected_counts, monthly_tokens, rank_import, roster_plan, fuzzy_names, tutor_digest, close_year, search_filter,
]
QUERIES = {f.__name__: f for f in NAMES}

_EXPECTED = """expected AS (SELECT DISTINCT assignment_id, user_id FROM (
  SELECT a.assignment_id, u.user_id FROM (SELECT assignment_id, unnest([assignment_id % 25, (assignment_id + 5) % 25, (assignment_id + 10) % 25, (assignment_id + 15) % 25, (assignment_id + 20) % 25]) AS class_id FROM assignments) a JOIN users u ON u.class_id = a.class_id
  UNION ALL SELECT CAST(year(o_orderdate) * 100 + quarter(o_orderdate) AS INT), o_custkey FROM orders WHERE o_orderpriority LIKE '1%') WHERE user_id IN (SELECT user_id FROM users WHERE balance > 0))"""
_GATE = f"""gate AS (SELECT a.assignment_id, count(o.assignment_id) FILTER (o.due_at IS NULL) > 0 AS unbounded, CASE WHEN count(o.assignment_id) FILTER (o.due_at IS NULL) = 0 THEN greatest(a.due_at, max(o.due_at) FILTER (o.due_at > TIMESTAMP '{NOW}')) END AS due_at,
  count(o.assignment_id) FILTER (o.due_at IS NULL OR o.due_at > TIMESTAMP '{NOW}') AS blocked_by FROM assignments a LEFT JOIN assignments o ON o.paper_id = a.paper_id AND o.assignment_id <> a.assignment_id GROUP BY a.assignment_id, a.due_at)"""
_BASE = ("attempts", "assignments", "users")
_FACTS = """facts AS (SELECT c_custkey AS user_id, c_custkey % 7 = 1 AND c_custkey % 2 <> 1 AS special, c_nationkey % 3 <> 0 AND NOT c_acctbal > 5000 AS star, c_custkey % 5 = 2 AND c_custkey % 3 <> 1 AS apply, c_custkey % 11 = 3 AS repeater,
  CASE WHEN c_custkey % 13 = 5 THEN true ELSE c_custkey % 9 <> 4 END AS same, c_nationkey % 3 = 1 AS low, c_nationkey % 3 = 2 AS high FROM customer),
may AS (SELECT user_id, true AS may_special, NOT special AND NOT repeater AND same AS may_star, NOT low AND NOT special AS may_apply, NOT low AND NOT special AND NOT high AS may_prefer, NOT special AND NOT star AND NOT apply AS may_place FROM facts)"""
_PIECES = """pieces AS (SELECT l_suppkey AS user_id, CAST(year(l_shipdate) AS INT) AS grade_year, (['OUTCOME', 'DIVERSE', 'SUMMARY'])[l_linenumber % 3 + 1] AS kind, list_transform(range(0, l_linenumber % 3 + 1), lambda i: 'P' || CAST((l_partkey + i * 7) % 5 AS VARCHAR)) AS selected FROM lineitem)"""

ORACLES = {
    "recipients": T.sql("SELECT * FROM expected", *_BASE, extra=_EXPECTED),
    "roster_tally": T.sql(
        """SELECT coalesce(e.assignment_id, a.assignment_id) AS assignment_id, count(e.user_id) AS expected, count(*) FILTER (e.user_id IS NOT NULL AND a.user_id IS NOT NULL) AS started, count(*) FILTER (e.user_id IS NOT NULL AND done) AS submitted,
  count(*) FILTER (e.user_id IS NOT NULL AND NOT done) AS in_progress, count(*) FILTER (a.user_id IS NULL) AS untouched, count(*) FILTER (e.user_id IS NULL) AS strangers
  FROM expected e FULL JOIN (SELECT assignment_id, user_id, bool_or(status <> 'IN_PROGRESS') AS done FROM attempts GROUP BY 1, 2) a ON a.assignment_id = e.assignment_id AND a.user_id = e.user_id GROUP BY 1""", *_BASE, extra=_EXPECTED),
    "roster_pick": T.sql("SELECT assignment_id, user_id, attempt_id, status FROM attempts QUALIFY row_number() OVER (PARTITION BY assignment_id, user_id ORDER BY CASE WHEN status = 'IN_PROGRESS' THEN 0 ELSE 1 END, started_at DESC, attempt_id DESC) = 1", "attempts"),
    "overdue_antijoin": T.sql(
        f"SELECT assignment_id, user_id FROM expected e WHERE assignment_id IN (SELECT assignment_id FROM assignments WHERE due_at <= TIMESTAMP '{LATER}' AND due_at > TIMESTAMP '{LATER}' - INTERVAL 3 DAYS) AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.assignment_id = e.assignment_id AND a.user_id = e.user_id AND status <> 'IN_PROGRESS')", *_BASE, extra=_EXPECTED),
    "due_soon_digest": T.sql(
        f"""SELECT user_id, count(*) AS n, string_agg(CAST(assignment_id AS VARCHAR), ',' ORDER BY CAST(assignment_id AS VARCHAR)) AS assignments FROM expected e WHERE assignment_id IN (SELECT assignment_id FROM assignments WHERE due_at > TIMESTAMP '{NOW}' AND due_at <= TIMESTAMP '{NOW}' + INTERVAL 24 HOURS)
  AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.assignment_id = e.assignment_id AND a.user_id = e.user_id AND status <> 'IN_PROGRESS') AND (SELECT count(*) FROM attempts WHERE status = 'IN_PROGRESS' AND started_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 2 HOURS AND TIMESTAMP '{NOW}') < 20 GROUP BY 1""", *_BASE, extra=_EXPECTED),
    "scope_semijoin": T.sql("SELECT question_id, kp_id AS subject, question_id % 30 AS created_by FROM questions WHERE question_id % 30 = 7 OR kp_id IN (SELECT 'Brand#' || CAST(s_nationkey + 1 AS VARCHAR) FROM supplier WHERE s_suppkey % 30 = 7)", "questions"),
    "cohort_gate": T.sql("SELECT assignment_id, unbounded, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS due_at, blocked_by FROM gate", "attempts", "assignments", extra=_GATE),
    "task_state": T.sql(
        f"""SELECT e.assignment_id, e.user_id, CASE WHEN is_open THEN 'IN_PROGRESS' WHEN last IS NOT NULL THEN 'DONE' WHEN open_at > TIMESTAMP '{NOW}' THEN 'UPCOMING' WHEN due_at <= TIMESTAMP '{NOW}' THEN 'MISSED' ELSE 'OPEN' END AS state, coalesce(used, 0) AS used, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_submitted
  FROM expected e JOIN assignments w ON w.assignment_id = e.assignment_id LEFT JOIN (SELECT assignment_id, user_id, count(*) AS used, bool_or(status = 'IN_PROGRESS') AS is_open, max(started_at) FILTER (status <> 'IN_PROGRESS') AS last FROM attempts GROUP BY 1, 2) a ON a.assignment_id = e.assignment_id AND a.user_id = e.user_id""", *_BASE, extra=_EXPECTED),
    "result_visibility": T.sql(
        f"""SELECT attempt_id, CASE WHEN policy = 'NEVER' OR status = 'IN_PROGRESS' THEN 'NONE' WHEN policy IN ('IMMEDIATE', 'ON_SUBMIT') THEN 'FULL' WHEN policy = 'ON_DUE' THEN CASE WHEN g.due_at < TIMESTAMP '{NOW}' THEN 'FULL' ELSE 'SCORE_ONLY' END
  WHEN policy = 'MANUAL' AND released_at <= TIMESTAMP '{NOW}' THEN 'FULL' ELSE 'NONE' END AS level FROM attempts t JOIN assignments a ON a.assignment_id = t.assignment_id JOIN gate g ON g.assignment_id = t.assignment_id""", "attempts", "assignments", extra=_GATE),
    "keyset_page": T.sql("SELECT attempt_id, user_id, price FROM attempts WHERE (price, attempt_id) < (250000.0, 0) ORDER BY price DESC, attempt_id DESC LIMIT 41", "attempts"),
    "class_consent_counts": T.sql("SELECT class_name, count(*) FILTER (balance > 0) AS active, count(*) FILTER (balance <= 0) AS waiting, count(DISTINCT segment) AS segments FROM users JOIN classes USING (class_id) GROUP BY 1", "users", "classes"),
    "tenant_dashboard": T.sql(
        """SELECT tenant_id, students, waiting, in_progress, submitted, graded, busy_classes FROM (SELECT tenant_id, count(*) AS students, count(*) FILTER (balance <= 0) AS waiting FROM users JOIN classes USING (class_id) GROUP BY 1) LEFT JOIN (
  SELECT tenant_id, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (status = 'SUBMITTED') AS submitted, count(*) FILTER (status = 'GRADED') AS graded, count(DISTINCT class_id) AS busy_classes FROM attempts JOIN users USING (user_id) JOIN classes USING (class_id) GROUP BY 1) USING (tenant_id)""", "attempts", "users", "classes"),
    "tenant_scope": T.sql("SELECT attempt_id, user_id, status FROM attempts WHERE user_id IN (SELECT user_id FROM users JOIN classes USING (class_id) WHERE tenant_id = 2)", "attempts", "users", "classes"),
    "upsert_latest": T.sql("SELECT user_id, status, attempt_id, price FROM attempts QUALIFY row_number() OVER (PARTITION BY user_id, status ORDER BY started_at DESC, attempt_id DESC) = 1", "attempts"),
    "expectations_violations": """SELECT rule, count(*) AS n, count(DISTINCT l_orderkey) AS keys FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN NOT l_discount <= 0.09::DOUBLE THEN 'discount_low' END, CASE WHEN NOT l_quantity > 1 THEN 'quantity_positive' END, CASE WHEN NOT l_extendedprice >= l_quantity * 950 THEN 'price_matches' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1""",
    "eligibility_rules": f"WITH {_FACTS}\nSELECT user_id, unnest(['SPECIAL_APPLY', 'STAR_APPLY', 'APPLY_APPLY', 'APPLY_PREFERENCE', 'PLACEMENT_REGISTER']) AS action, unnest([may_special, may_star, may_apply, may_prefer, may_place]) AS ok FROM may",
    "plan_conflicts": f"""WITH {_FACTS},
counts AS (SELECT o_custkey AS user_id, count(*) FILTER (ch = 'SPECIAL') AS special, count(*) FILTER (ch = 'STAR') AS star, count(*) FILTER (ch = 'APPLY') AS apply, count(*) FILTER (ch = 'PLACEMENT') AS place, count(*) FILTER (ch = 'STAR' AND g <= 7) AS low, count(*) FILTER (ch = 'STAR' AND g = 8) AS high, count(DISTINCT (inst, g)) FILTER (ch = 'STAR') AS places
  FROM (SELECT o_custkey, (['STAR', 'APPLY', 'APPLY', 'PLACEMENT', 'SPECIAL'])[o_orderkey % 5 + 1] AS ch, o_orderkey % 50 AS inst, o_orderkey % 8 + 1 AS g FROM orders) GROUP BY 1)
SELECT * FROM (SELECT user_id, unnest([CASE WHEN low > 0 AND apply > 0 THEN 'STAR_1_7_KILLS_APPLY' END, CASE WHEN high > 0 AND apply > 0 THEN 'STAR_8_KILLS_APPLY_PREFERENCE' END, CASE WHEN place > 0 AND (star > 0 OR apply > 0) THEN 'EARLIER_CHANNEL_KILLS_PLACEMENT' END,
  CASE WHEN special > 0 AND (star > 0 OR apply > 0 OR place > 0) THEN 'SPECIAL_KILLS_EVERYTHING' END, CASE WHEN star > 0 AND NOT may_star THEN 'ALREADY_BLOCKED_STAR' END, CASE WHEN apply > 0 AND NOT may_apply THEN 'ALREADY_BLOCKED_APPLY' END, CASE WHEN place > 0 AND NOT may_place THEN 'ALREADY_BLOCKED_PLACEMENT' END,
  CASE WHEN apply > 0 AND may_apply AND NOT may_prefer THEN 'APPLY_PREFERENCE_BLOCKED' END, CASE WHEN apply > 6 THEN 'APPLY_OVER_LIMIT' END, CASE WHEN places > 1 THEN 'STAR_MULTI_POSITION' END]) AS code FROM counts JOIN may USING (user_id)) WHERE code IS NOT NULL""",
    "portfolio_upload_counts": f"""WITH {_PIECES}\nSELECT user_id, grade_year, outcome, diverse, CAST(greatest(60 - outcome, 0) AS BIGINT) AS outcome_left, CAST(greatest(30 - diverse, 0) AS BIGINT) AS diverse_left, outcome > 60 AS outcome_over, diverse > 30 AS diverse_over FROM (
  SELECT user_id, grade_year, count(*) FILTER (kind = 'OUTCOME') AS outcome, count(*) FILTER (kind = 'DIVERSE') AS diverse FROM pieces GROUP BY 1, 2)""",
    "portfolio_selected_counts": f"WITH {_PIECES}\nSELECT p.user_id, p.program, coalesce(n, 0) AS n FROM (SELECT s_suppkey AS user_id, unnest(['P0', 'P1', 'P2', 'P3', 'P4', 'P5', 'P6']) AS program FROM supplier) p LEFT JOIN (SELECT user_id, program, count(*) AS n FROM (SELECT user_id, unnest(selected) AS program FROM pieces) GROUP BY 1, 2) c ON c.user_id = p.user_id AND c.program = p.program",
    "monthly_tokens": T.sql("SELECT tenant_id, month, calls, tokens, floor(tokens * 3.0 / 1e6 * 1e6 + 0.5) / 1e6 AS cost FROM (SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) AS calls, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM events JOIN users USING (user_id) JOIN classes USING (class_id) GROUP BY 1, 2)", "users", "classes"),
    "rank_import": """WITH lines AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 17 = 3 THEN '' ELSE 'u' || CAST(c_custkey // 2 AS VARCHAR) END AS username, CASE WHEN c_custkey % 3 <= 1 THEN printf('%.1f', c_acctbal / 100) WHEN c_custkey % 11 = 5 THEN 'n/a' ELSE printf('%.1f', c_acctbal / 50) END AS raw, CASE WHEN c_custkey % 4 = 0 THEN 4.0 ELSE 5.0 END AS semesters FROM customer),
checked AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS v, CASE WHEN username = '' THEN 'NO_USERNAME' WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN 'NOT_A_NUMBER' WHEN TRY_CAST(raw AS DOUBLE) NOT BETWEEN 0 AND 100 THEN 'OUT_OF_RANGE' END AS bad FROM lines),
judged AS (SELECT *, CASE WHEN username <> '' AND line > min(line) FILTER (bad IS NULL) OVER (PARTITION BY username) THEN 'DUPLICATE' ELSE bad END AS problem FROM checked)
SELECT line, username, CASE WHEN problem IS NULL THEN v END AS percentile, CASE WHEN problem IS NULL THEN semesters END AS semesters, problem FROM judged""",
    "roster_plan": """WITH r AS (SELECT 'u' || CAST(CASE WHEN c_custkey % 50 = 1 THEN c_custkey // 2 ELSE c_custkey END AS VARCHAR) AS username, CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer),
u AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS username, c_name FROM customer WHERE c_nationkey < 20), g AS (SELECT username, count(*) AS n, min(name) AS name FROM r GROUP BY 1)
SELECT g.username, CASE WHEN n > 1 THEN 'DUPLICATE' WHEN trim(name) = '' THEN 'NO_NAME' WHEN u.username IS NULL THEN 'CREATE' WHEN name <> c_name THEN 'RENAME' ELSE 'KEEP' END AS action FROM g LEFT JOIN u ON u.username = g.username""",
    "fuzzy_names": T.sql("SELECT user_id, wish_rank, class_id AS threshold FROM wishes w JOIN classes c ON c.class_name = w.institution WHERE (class_id % 2 <> 0 OR class_id % 8 + 1 = star_group) AND (class_id % 3 <> 0 OR user_id % 3 = 1)", "wishes", "classes"),
    "tutor_digest": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, max(length(text)) AS longest, arg_max(role, turn) = 'assistant' AS closed FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 DESC LIMIT 300) GROUP BY 1",
    "close_year": T.sql("SELECT attempt_id, CASE WHEN status = 'GRADED' THEN strftime(started_at, '%Y-%m-%d') ELSE '2001-01-31' END AS left_at FROM attempts", "attempts"),
    "search_filter": "SELECT p_name, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name ILIKE '%BLUE%' AND l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2000-04-01' GROUP BY 1",
}
_CLASS, _GIVEN = ("([" + ", ".join(f"'{n}'" for n in names) + "])[CAST({} AS BIGINT) % " + str(len(names)) + " + 1]" for names in (CLASS_NAMES, GIVEN))
ORACLES["roster_by_strokes"] = f"""SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY class COLLATE zh_tw, name COLLATE zh_tw, c_custkey) AS INT) AS position FROM (
  SELECT *, {_CLASS.format('c_custkey')} AS class, {_GIVEN.format('c_custkey // 3')} || {_GIVEN.format('c_custkey // 7')} AS name FROM customer)"""
ORACLES["names_by_letters"] = f"SELECT c_nationkey, min(name) AS name, count(*) AS n FROM (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN upper({_CLASS.format('c_custkey')}) ELSE {_CLASS.format('c_custkey')} END AS name FROM customer) GROUP BY c_nationkey, lower(name)"
