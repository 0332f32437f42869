"""Registered queries on what may be done to attempts, questions, portfolios and proposed grades, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from ..operators import portfolio, tutor
from ..sources import tables as T

NOW = "1998-06-01 00:00:00"
STATES = ["IN_PROGRESS", "SUBMITTED", "GRADED", "IN_PROGRESS"]
TYPES = ["SINGLE_CHOICE", "MULTI_CHOICE", "TRUE_FALSE", "FILL_SLOT", "FILL_TEXT", "ESSAY", "SHORT_ANSWER", "TRANSLATION", "ODD"]
SEMESTERS = ["高一上", "高二下", "高3", "g1 autumn", "12年級", "X", ""]
QUOTA = {"OUTCOME": 6, "DIVERSE": 10}


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (key % len(values) + 1).cast("int"))


def _days(key, n):
    return F.make_dt_interval(days=(key % n).cast("int"))


def _text(at):
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def _sittings(s, d):
    """Orders as sittings of all states, some without an end, a due time or a rule for late work."""
    k = F.col("o_orderkey")
    return T.scan(s, d, "orders").select(
        k.alias("attempt_id"), F.when(k % 11 == 0, "VOIDED").when(k % 101 == 1, "ODD").otherwise(_pick(STATES, k)).alias("status"), F.when(k % 5 != 0, F.col("o_orderdate") + _days(k, 1500)).alias("expires_at"),
        F.when(k % 4 < 2, F.col("o_orderdate") + _days(k, 900)).alias("due_at"), F.when(k % 3 < 2, k % 3 == 0).alias("allow_late"), F.when(k % 6 < 4, F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1))).alias("submitted_at"),
        F.when(k % 97 != 0, (k % 700 - 20).cast("int")).alias("minutes"), "o_orderdate",
    )


def attempt_guards(s, d):
    late = ("status", "expires_at", "due_at", "allow_late", NOW)
    end, again = G.extended("status", "expires_at", "minutes", NOW)
    return _sittings(s, d).select(
        "attempt_id", G.stranded(*late).alias("stranded"), G.may_finalize(*late).alias("finalize"), G.may_extend("status", "expires_at", "minutes").alias("extend"), _text(end).alias("new_end"), again.alias("reopened"),
        G.may_end_now(*late).alias("end_now"), G.may_void("status").alias("void"), G.restored("status", "submitted_at").alias("restored"), G.remaining_seconds("expires_at", NOW).alias("remaining"),
    )


def _drafts(s, d):
    """Parts as questions in preparation, with the faults that such drafts have."""
    k = F.col("p_partkey")
    option = lambda i: F.struct(F.lit(i).alias("order"), F.when(k % 13 == i, "![[a:x9]]").otherwise(F.col("p_name")).alias("content"))
    return T.scan(s, d, "part").select(
        k.alias("question_id"), _pick(TYPES, k).alias("type"), F.when(k % 17 == 0, " ").when(k % 19 == 0, "see ![[a:a1]] and ![[a:a2]]").otherwise(F.col("p_name")).alias("content"),
        F.slice(F.array(option(1), option(2), option(3)), 1, (k % 4).cast("int")).alias("options"), F.slice(F.array(F.lit(1), F.lit(3)), 1, (k % 3).cast("int")).alias("keys"), F.when(k % 5 > 0, F.array(F.when(k % 7 == 0, "").otherwise("4"), F.lit(" "))).alias("slots"),
        F.when(k % 6 > 0, F.col("p_type")).alias("answer_text"), F.when(k % 3 > 0, F.array(F.lit("a1"), F.lit("x9"))).alias("assets"), (k % 2).alias("points"), F.when(k % 8 > 0, F.col("p_size")).alias("score"), (k % 5).alias("explanations"),
    )


def question_publish_issues(s, d):
    return G.publish_issues(_drafts(s, d))


def question_retire_blockers(s, d):
    p = T.scan(s, d, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 9).alias("paper_id"))
    papers = s.range(9).select(F.col("id").alias("paper_id"), F.when(F.col("id") == 8, "ARCHIVED").otherwise("PUBLISHED").alias("status"))
    return G.retire_blockers(p, papers, T.assignments(s, d), NOW)


def question_type_change(s, d):
    k = F.col("p_partkey")
    return T.scan(s, d, "part").select(k.alias("question_id"), G.may_change_type(_pick(TYPES, k), _pick(TYPES, F.floor(k / 4)), F.when(k % 3 > 0, k % 5)).alias("ok"))


def portfolio_may_add(s, d):
    """Line items of one linenumber as new pieces beside those of all others."""
    li = T.scan(s, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "l_linenumber", G.grade_year(_pick(SEMESTERS, F.col("l_partkey"))).alias("grade_year"), _pick(["OUTCOME", "DIVERSE", "SUMMARY"], F.col("l_orderkey")).alias("kind"), (F.col("l_orderkey") % 25).alias("part"))
    return G.may_add(li.where("part = 0 and l_linenumber > 1"), li.where("part = 0 and l_linenumber = 1"), QUOTA)


RATIONALES = ["The answer names three causes and a date", "short", "It says 「three causes and」 which is right", 'He writes "nobody ever wrote this" here', "Well argued throughout, with a good structure"]
ANSWERS = ["There were three causes and a date to know", "", "The river rose, three causes and", "of"]


def _proposals(s, d):
    k = F.col("o_orderkey")
    dim = lambda name, score, most, reason: F.struct(F.lit(name).alias("id"), score.cast("double").alias("score"), most.cast("double").alias("most"), reason.alias("reason"))
    three = F.array(dim("a", k % 5, F.lit(4), F.when(k % 7 > 0, "because")), dim("b", F.when(k % 23 > 0, k % 4 - (k % 29 == 0).cast("int")), F.when(k % 31 == 0, F.lit(7)).otherwise(F.lit(3)), F.lit("so")), dim("z", F.lit(0), F.lit(1), F.lit("new")))
    p = T.scan(s, d, "orders").select(
        k.alias("proposal_id"), (k % 10).alias("question_id"), F.when(k % 37 > 0, (k % 5 + k % 4 + (k % 6 == 0).cast("int")).cast("double")).alias("total"), _pick(RATIONALES, k).alias("rationale"), _pick(ANSWERS, F.floor(k / 5)).alias("answer"),
        F.lit("Explain the causes. The river rose.").alias("public"), F.slice(three, 1, F.when(k % 41 == 0, 3).when(k % 43 == 0, 1).otherwise(2)).alias("dimensions"),
    )
    rubric = s.range(10).select(F.col("id").alias("question_id"), F.explode(F.array(F.struct(F.lit("a").alias("id"), F.lit(4.0).alias("max_score")), F.struct(F.lit("b").alias("id"), F.lit(3.0).alias("max_score")))).alias("r")).select("question_id", "r.*")
    return p, rubric


def grade_proposal_issues(s, d):
    return G.proposal_issues(*_proposals(s, d))


def submission_checklist(s, d):
    """Suppliers as students, their line items as pieces and every third part they supply as a program."""
    li = T.scan(s, d, "lineitem").where("l_linenumber <= 2")
    u = F.col("l_suppkey").alias("user_id")
    items = li.select(u, (F.col("l_orderkey") % 30).alias("grade_year"), _pick(["OUTCOME", "DIVERSE", "SUMMARY"], F.col("l_orderkey")).alias("kind"), F.slice(F.array((F.col("l_partkey") % 4).cast("string")), 1, (F.col("l_orderkey") % 2).cast("int")).alias("selected_for"))
    programs = li.where("l_partkey % 40 = 0 and l_suppkey % 5 > 0").select(u, "l_partkey", F.when(F.col("l_partkey") % 7 > 0, F.when(F.col("l_partkey") % 9 == 0, "MIXED").otherwise("PDF")).alias("mode"), F.when(F.col("l_partkey") % 11 > 0, F.lit("05-20")).alias("deadline")).distinct()
    return G.submission_checklist(T.scan(s, d, "supplier").select(F.col("s_suppkey").alias("user_id")), programs.withColumnRenamed("l_partkey", "program"), items, "2024-05-03 21:00:00", {"OUTCOME": 6, "DIVERSE": 10}, {"OUTCOME": 20, "DIVERSE": 60})


#: What a tutor says ({n} is the question's number), whether the question has options, what the student said before, and the leaks that it is.
SAID = [
    ("答案是 (3)。", True, None, ["ANSWER_PHRASE"]), ("(3) 是對的", True, None, ["AFFIRM_LABEL"]), ("you may pick (3)", True, None, ["PICK_CORRECT"]), ("第 3 個 is right", True, None, ["ORDINAL_REVEAL"]), ("(1) 不對，(2) 不成立，(4) 不行", True, None, ["ELIMINATE_ALL"]),
    ("so photosynthesis makes sugar 成立", True, None, ["CORRECT_CONTENT"]), ("x = {n}", False, None, ["ANSWER_PHRASE", "COMPUTED_TO_END", "BARE_ANSWER"]), ("look at {n} once more", False, None, ["BARE_ANSWER"]), ("count {n} 個", False, None, []), ("對了", True, "是不是 (3)", ["AFFIRM_GUESS"]),
    ("what does (3) say", True, "是不是 (3)", []), ("x is {n}9", False, None, []), ("剩下 (3)", True, None, ["AFFIRM_LABEL"]), ("hm", True, None, []),
]


def tutor_guard(s, d):
    """The assistant's turns with a remark in front, each against the question that its conversation is about: the leaks."""
    c = T.scan(s, d, "conversations").where("role = 'assistant'")
    k = (F.col("conv_id") + F.col("turn")) % len(SAID)
    number = (F.col("conv_id") * 7919 + 1_000_003).cast("string")
    pick = lambda i, kind: F.element_at(F.array(*[F.lit(x[i]).cast(kind) for x in SAID]), (k + 1).cast("int"))
    choice = pick(1, "boolean")
    replies = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), (F.col("conv_id") * 2 + choice.cast("int")).alias("question_id"), F.concat_ws(" ", F.replace(pick(0, "string"), F.lit("{n}"), number), "text").alias("reply"), pick(2, "string").alias("student"))
    option = lambda n, text, ok: F.struct(F.lit(f"({n})").alias("label"), F.lit(text).alias("content"), F.lit(ok).alias("correct"))
    options = F.array(option(1, "rocks make sugar", False), option(2, "rain makes salt", False), option(3, "photosynthesis makes sugar", True), option(4, "wind makes light", False))
    ids = c.select("conv_id").distinct().select(F.explode(F.array(F.col("conv_id") * 2, F.col("conv_id") * 2 + 1)).alias("question_id"), number.alias("number"))
    has = F.col("question_id") % 2 == 1
    questions = ids.select("question_id", F.lit("which of these holds").alias("stem"), F.lit(None).cast("string").alias("my_text"), F.when(has, options).alias("options"), F.when(~has, F.array("number")).alias("texts"))
    return tutor.reply_violations(replies, questions).where("severity = 'LEAK'").select("reply_id", "code")


#: What feedback says first, and the text to paste that it is.
REMARKS = [
    ("我參加了資訊社並且在社團裡學會了寫程式後來我帶著同學一起完成了一個專題作品並且拿到了不錯的名次", ["FIRST_PERSON_RUN"]), ("該生參加了資訊社並且在社團裡學會了寫程式後來帶著同學一起完成了一個專題作品並且拿到了不錯的名次", ["THIRD_PERSON_RUN"]), ("我從小喜歡看星星所以常常一個人去爬山露營和拍照", ["NARRATIVE_VOICE"]),
    ("現在幫你寫一段", ["GHOSTWRITE_LEAD"]), ("我沒有辦法幫你寫這一段", []), ("這份作品從題目發想到資料收集都有清楚的紀錄。圖表的安排也能看出對於主題的掌握與持續的修正與調整。", ["PASTEABLE"]), ("貴系的課程很好", ["APPLICATION_VOICE"]), ("你可以再想想這一段嗎？", []), ("", []),
]


def feedback_guard(s, d):
    """The assistant's turns as feedback with a remark in front, the turn's own text being the student's."""
    c = T.scan(s, d, "conversations").where("role = 'assistant'")
    remark = _pick([r for r, _ in REMARKS], F.col("conv_id") + F.col("turn"))
    f = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("feedback_id"), F.concat_ws("\n", remark, "text").alias("text"), F.col("text").alias("own"))
    return portfolio.feedback_violations(f).where("severity = 'GHOST'").select("feedback_id", "code")


#: Uses of the tool by log, statements, and where each statement departs from each log.
LOGS = [[], ["WRITING_FEEDBACK", "WRITING_FEEDBACK"], ["MATERIAL_HINT", "INTERVIEW_FEEDBACK"], ["CHAT", " "]]
_UNUSED, _OMITS, _SILENT, _NOT_OWN = "CLAIMS_UNUSED_FEATURE", "OMITS_FEATURE", "SILENT_WHEN_UNUSED", "NO_OWN_WORK_CLAIM"
STATEMENTS = [
    ("本文未使用 AI 工具，由本人獨立完成。", [[], ["CLAIMS_NO_AI", _OMITS], ["CLAIMS_NO_AI", _OMITS], []]), ("使用AI進行文字回饋共 2 次，構思與撰寫由本人完成。", [[_UNUSED, "MISCOUNTS", _SILENT], [], [_OMITS, _UNUSED], [_UNUSED, "MISCOUNTS"]]),
    ("以ＡＩ輔助素材回想與模擬面試。", [[_UNUSED, _SILENT, _NOT_OWN], [_OMITS, _UNUSED, _NOT_OWN], [_NOT_OWN], [_UNUSED, _NOT_OWN]]), ("內容由AI協助生成，本人自行完成。", [["CLAIMS_GENERATION", _SILENT], ["CLAIMS_GENERATION", _OMITS], ["CLAIMS_GENERATION", _OMITS], ["CLAIMS_GENERATION"]]),
    (None, [["EMPTY", _SILENT, _NOT_OWN], ["EMPTY", _OMITS, _NOT_OWN], ["EMPTY", _OMITS, _NOT_OWN], ["EMPTY", _NOT_OWN]]), ("並未由AI生成，由本人撰寫。", [[_SILENT], [_OMITS], [_OMITS], []]),
]


def disclosure_guard(s, d):
    """Orders as statements, each with the log of its customer's uses."""
    k = F.col("o_orderkey")
    o = T.scan(s, d, "orders").select(k.alias("statement_id"), F.element_at(F.array(*[F.lit(t) for t, _ in STATEMENTS]), (k % len(STATEMENTS) + 1).cast("int")).alias("text"), F.element_at(F.array(*[F.array(*[F.lit(x) for x in log]).cast("array<string>") for log in LOGS]), (F.col("o_custkey") % len(LOGS) + 1).cast("int")).alias("log"))
    return portfolio.disclosure_violations(o, o.select("statement_id", F.explode("log").alias("feature"))).select("statement_id", "code")


NAMES = [
    tutor_guard, feedback_guard, disclosure_guard,submission_checklist, attempt_guards, question_publish_issues, question_retire_blockers, question_type_change, portfolio_may_add, grade_proposal_issues]
QUERIES = {f.__name__: f for f in NAMES}


def _list(values, key):
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST(floor({key}) AS BIGINT) % {len(values)} + 1]"


_FAMILY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in G.FAMILIES.items()) + "}"
_N = f"TIMESTAMP '{NOW}'"
_SITTINGS = f"""sittings AS (SELECT *, status = 'IN_PROGRESS' AS running, coalesce({_N} > expires_at, false) OR coalesce(NOT coalesce(allow_late, false) AND {_N} > due_at, false) AS over FROM (
  SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 11 = 0 THEN 'VOIDED' WHEN o_orderkey % 101 = 1 THEN 'ODD' ELSE {_list(STATES, 'o_orderkey')} END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 1500 AS INT)) END AS expires_at,
  CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate + to_days(CAST(o_orderkey % 900 AS INT)) END AS due_at, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS allow_late, CASE WHEN o_orderkey % 6 < 4 THEN o_orderdate END AS submitted_at,
  CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderkey % 700 - 20 AS INT) END AS minutes FROM orders))"""
_DRAFTS = f"""drafts AS (SELECT *, ({_FAMILY})[type] AS fam, [content] || list_transform(options, lambda o: o.content) AS texts FROM (SELECT p_partkey AS question_id, {_list(TYPES, 'p_partkey')} AS type,
  CASE WHEN p_partkey % 17 = 0 THEN ' ' WHEN p_partkey % 19 = 0 THEN 'see ![[a:a1]] and ![[a:a2]]' ELSE p_name END AS content,
  (list_transform([1, 2, 3], lambda i: {{'order': i, 'content': CASE WHEN p_partkey % 13 = i THEN '![[a:x9]]' ELSE p_name END}}))[1:p_partkey % 4] AS options, ([1, 3])[1:p_partkey % 3] AS keys,
  p_partkey % 5 > 0 AND p_partkey % 7 <> 0 AS has_slot, p_partkey % 6 > 0 AS has_text, CASE WHEN p_partkey % 3 > 0 THEN ['a1', 'x9'] ELSE [] END AS assets, p_partkey % 2 AS points, CASE WHEN p_partkey % 8 > 0 THEN p_size END AS score, p_partkey % 5 AS explanations FROM part))"""
_PROPOSALS = rf"""base AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 37 > 0 THEN CAST(o_orderkey % 5 + o_orderkey % 4 + CAST(o_orderkey % 6 = 0 AS INT) AS DOUBLE) END AS total, {_list(RATIONALES, 'o_orderkey')} AS rationale, {_list(ANSWERS, 'o_orderkey / 5')} AS answer,
  CASE WHEN o_orderkey % 41 = 0 THEN 3 WHEN o_orderkey % 43 = 0 THEN 1 ELSE 2 END AS n, CAST(o_orderkey % 5 AS DOUBLE) AS sa, CASE WHEN o_orderkey % 23 > 0 THEN CAST(o_orderkey % 4 - CAST(o_orderkey % 29 = 0 AS INT) AS DOUBLE) END AS sb FROM orders),
told AS (SELECT *, rationale || CASE WHEN k % 7 > 0 THEN 'because' ELSE '' END || CASE WHEN n > 1 THEN 'so' ELSE '' END || CASE WHEN n > 2 THEN 'new' ELSE '' END AS whole FROM base),
bare AS (SELECT *, regexp_replace(lower(whole), '[^0-9a-z㐀-䶿一-鿿豈-﫿]+', '', 'g') AS words, regexp_replace(lower(answer), '[^0-9a-z㐀-䶿一-鿿豈-﫿]+', '', 'g') AS own, 'explainthecausestheriverrose' AS open,
  list_transform(regexp_extract_all(rationale, '「([^」]{{1,60}})」', 1) || regexp_extract_all(rationale, '"([^"]{{1,60}})"', 1), lambda q: regexp_replace(lower(q), '[^0-9a-z㐀-䶿一-鿿豈-﫿]+', '', 'g')) AS quotes FROM told),
checked AS (SELECT *, len(list_filter(quotes, lambda q: length(q) >= 3 AND contains(own, q))) > 0 AS proven,
  list_aggregate(list_transform(range(1, length(own) - least(6, length(own)) + 2), lambda i: contains(words, substring(own, i, least(6, length(own)))) AND NOT contains(open, substring(own, i, least(6, length(own))))), 'bool_or') AS six,
  list_aggregate(list_transform(range(1, length(own) - least(8, length(own)) + 2), lambda i: contains(words, substring(own, i, least(8, length(own)))) AND NOT contains(open, substring(own, i, least(8, length(own))))), 'bool_or') AS eight FROM bare)"""
_CODES = {
    "BAD_SCORE": "total IS NULL OR (n > 1 AND sb IS NULL)",
    "OVER_TOTAL": "total > 7.01",
    "UNKNOWN_DIMENSION": "n > 2",
    "DIM_NEGATIVE": "n > 1 AND sb < 0",
    "DIM_MAX_MISMATCH": "n > 1 AND k % 31 = 0 AND sb IS NOT NULL",
    "NO_DIM_REASON": "k % 7 = 0",
    "MISSING_DIMENSION": "n < 2",
    "SUM_MISMATCH": "total IS NOT NULL AND abs(sa + CASE WHEN n > 1 THEN coalesce(sb, 0) ELSE 0 END - total) > 0.01",
    "EMPTY_RATIONALE": "length(words) < 12",
    "BLANK_BUT_SCORED": "own = '' AND total > 0",
    "GENERIC_RATIONALE": "own <> '' AND NOT proven AND NOT six",
    "FABRICATED_QUOTE": "own <> '' AND len(list_filter(quotes, lambda q: length(q) >= 5 AND NOT contains(own, q) AND NOT contains(open, q))) > 0",
    "EXTREME_NO_REASON": "own <> '' AND (total <= 0 OR total >= 6.99) AND NOT proven AND NOT eight",
}
ORACLES = {
    "attempt_guards": f"""WITH {_SITTINGS} SELECT attempt_id, running AND over AS stranded, CASE WHEN status = 'VOIDED' THEN 'VOIDED' WHEN NOT running THEN 'HANDED_IN' WHEN over THEN 'OK' WHEN expires_at IS NULL AND due_at IS NULL THEN 'NO_END' ELSE 'STILL_OPEN' END AS finalize,
  extend, CASE WHEN extend = 'OK' THEN strftime(expires_at + to_minutes(minutes), '%Y-%m-%d %H:%M:%S') END AS new_end, CASE WHEN extend = 'OK' THEN {_N} > expires_at AND {_N} <= expires_at + to_minutes(minutes) END AS reopened,
  CASE WHEN NOT running THEN 'NOT_RUNNING' WHEN over THEN 'ALREADY_CLOSED' ELSE 'OK' END AS end_now, CASE status WHEN 'VOIDED' THEN 'ALREADY' WHEN 'ODD' THEN 'UNKNOWN_STATUS' ELSE 'OK' END AS void,
  CASE WHEN status = 'VOIDED' THEN CASE WHEN submitted_at IS NULL THEN 'IN_PROGRESS' ELSE 'SUBMITTED' END END AS restored, greatest(0, CAST(epoch(expires_at) - epoch({_N}) AS BIGINT)) AS remaining FROM (
  SELECT *, CASE WHEN minutes IS NULL OR minutes <= 0 THEN 'BAD_MINUTES' WHEN minutes > 600 THEN 'TOO_LONG' WHEN status = 'VOIDED' THEN 'VOIDED' WHEN NOT running THEN 'HANDED_IN' WHEN expires_at IS NULL THEN 'NO_END' ELSE 'OK' END AS extend FROM sittings)""",
    "question_publish_issues": f"WITH {_DRAFTS} " + " UNION ALL ".join(
        f"SELECT question_id, '{severity}' AS severity, '{code}' AS code FROM drafts WHERE {rule}" for severity, code, rule in [
            ("BLOCK", "empty_content", "trim(content) = ''"), ("BLOCK", "unknown_type", "fam IS NULL"), ("BLOCK", "too_few_options", "fam = 'CHOICE' AND len(options) < 2"),
            ("BLOCK", "no_answer", "(fam = 'CHOICE' AND len(keys) = 0) OR (type = 'FILL_SLOT' AND NOT has_slot) OR (type = 'FILL_TEXT' AND NOT has_text)"), ("BLOCK", "answer_orphan", "fam = 'CHOICE' AND len(list_filter(keys, lambda x: x > len(options))) > 0"),
            ("BLOCK", "multi_answer_on_single", "fam = 'CHOICE' AND type <> 'MULTI_CHOICE' AND len(keys) > 1"), ("BLOCK", "missing_asset", r"len(list_filter(flatten(list_transform(texts, lambda t: regexp_extract_all(t, '!\[\[a:([^\]\s]+)\]\]', 1))), lambda x: NOT list_contains(assets, x))) > 0"),
            ("WARN", "no_knowledge_point", "points = 0"), ("WARN", "zero_score", "coalesce(score, 0) <= 0"), ("WARN", "no_explanation", "explanations = 0"),
        ]),
    "question_retire_blockers": T.sql(
        f"""SELECT p_partkey AS question_id, kind, id FROM part JOIN (SELECT paper_id, 'assignment' AS kind, assignment_id AS id FROM assignments WHERE due_at IS NULL OR due_at > {_N}
  UNION ALL SELECT i, 'paper', i FROM range(8) r(i) WHERE i NOT IN (SELECT paper_id FROM assignments)) ON paper_id = p_partkey % 9""", "attempts", "assignments"),
    "question_type_change": f"""SELECT p_partkey AS question_id, a = b OR NOT coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END > 0, false) OR ({_FAMILY})[a] IS NOT DISTINCT FROM ({_FAMILY})[b] AS ok
  FROM (SELECT p_partkey, {_list(TYPES, 'p_partkey')} AS a, {_list(TYPES, 'p_partkey / 4')} AS b FROM part)""",
    "portfolio_may_add": f"""WITH i AS (SELECT l_suppkey AS user_id, l_orderkey * 10 + l_linenumber AS item, l_linenumber, (['G1', 'G2', 'G3', 'G1', 'G3', 'UNKNOWN', 'UNKNOWN'])[l_partkey % 7 + 1] AS grade_year, (['OUTCOME', 'DIVERSE', 'SUMMARY'])[l_orderkey % 3 + 1] AS kind FROM lineitem WHERE l_orderkey % 25 = 0),
c AS (SELECT *, (SELECT count(*) FROM i o WHERE o.l_linenumber > 1 AND o.user_id = i.user_id AND o.grade_year = i.grade_year AND o.kind = i.kind) AS used FROM i WHERE l_linenumber = 1)
SELECT user_id, item, NOT stop AS ok, CASE WHEN stop THEN lower(kind) || '_full' END AS reason FROM (SELECT *, grade_year <> 'UNKNOWN' AND CASE kind WHEN 'OUTCOME' THEN used = {QUOTA['OUTCOME']} WHEN 'DIVERSE' THEN used = {QUOTA['DIVERSE']} ELSE false END AS stop FROM c)""",
    "submission_checklist": """WITH li AS (SELECT l_suppkey AS user_id, l_partkey, l_orderkey % 30 AS y, l_orderkey % 3 AS kind, l_orderkey % 2 AS has FROM lineitem WHERE l_linenumber <= 2),
p AS (SELECT user_id, count(*) AS n, count(*) FILTER (l_partkey % 7 = 0) AS no_mode, count(*) FILTER (l_partkey % 7 > 0 AND l_partkey % 9 = 0) AS mixed, count(*) FILTER (l_partkey % 11 = 0) AS no_deadline FROM (SELECT DISTINCT user_id, l_partkey FROM li WHERE l_partkey % 40 = 0 AND user_id % 5 > 0) GROUP BY 1),
c AS (SELECT user_id, bool_or(o > 6 OR v > 10) AS full FROM (SELECT user_id, y, count(*) FILTER (kind = 0) AS o, count(*) FILTER (kind = 1) AS v FROM li GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT user_id, bool_or(o > 20 OR v > 60) AS full FROM (SELECT user_id, l_partkey % 4, count(*) FILTER (kind = 0) AS o, count(*) FILTER (kind = 1) AS v FROM li WHERE has = 1 GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT s_suppkey AS user_id, coalesce(n, 0) AS n, no_mode, mixed, no_deadline, c.full AS central, x.full AS selected FROM supplier LEFT JOIN p ON p.user_id = s_suppkey LEFT JOIN c ON c.user_id = s_suppkey LEFT JOIN x ON x.user_id = s_suppkey)
SELECT user_id, 'WINDOW_START' AS code, true AS ok, 'INFO' AS severity FROM j UNION ALL SELECT user_id, 'WINDOW_DAILY', false, 'WARN' FROM j UNION ALL SELECT user_id, 'PROGRAMS_LISTED', n > 0, 'BLOCK' FROM j UNION ALL SELECT user_id, 'MODE_CHOSEN', n > 0 AND no_mode = 0, 'BLOCK' FROM j
UNION ALL SELECT user_id, 'MODE_NOT_MIXED', n > 0 AND mixed = 0, 'BLOCK' FROM j UNION ALL SELECT user_id, 'DEADLINE_KNOWN', n > 0 AND no_deadline = 0, 'WARN' FROM j UNION ALL SELECT user_id, 'COUNT_CENTRAL', NOT coalesce(central, false), 'BLOCK' FROM j
UNION ALL SELECT user_id, 'COUNT_SELECTED', (n > 0 OR selected IS NOT NULL) AND NOT coalesce(selected, false), 'BLOCK' FROM j""",
    "grade_proposal_issues": f"WITH {_PROPOSALS} " + " UNION ALL ".join(f"SELECT k AS proposal_id, '{code}' AS code FROM checked WHERE {rule}" for code, rule in _CODES.items()),
}
ORACLES["tutor_guard"] = f"""SELECT conv_id * 1000 + turn AS reply_id, unnest(codes) AS code FROM (SELECT conv_id, turn, ([{', '.join('[' + ', '.join(f"'{c}'" for c in x[3]) + ']' for x in SAID)}])[(conv_id + turn) % {len(SAID)} + 1] AS codes FROM conversations WHERE role = 'assistant')"""
ORACLES["feedback_guard"] = f"""SELECT conv_id * 1000 + turn AS feedback_id, unnest(codes) AS code FROM (SELECT conv_id, turn, ([{', '.join('[' + ', '.join(f"'{c}'" for c in codes) + ']' for _, codes in REMARKS)}])[(conv_id + turn) % {len(REMARKS)} + 1] AS codes FROM conversations WHERE role = 'assistant')"""
_MATRIX = ", ".join("[" + ", ".join("[" + ", ".join(f"'{c}'" for c in codes) + "]" for codes in by_log) + "]" for _, by_log in STATEMENTS)
ORACLES["disclosure_guard"] = f"SELECT o_orderkey AS statement_id, unnest(([{_MATRIX}])[o_orderkey % {len(STATEMENTS)} + 1][o_custkey % {len(LOGS)} + 1]) AS code FROM orders"
