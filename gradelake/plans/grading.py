"""Registered queries on grading, prediction and placement, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import grading as G
from ..functions import randoms
from ..functions.numeric import normal_cdf, round_half_up, wilson
from ..operators import grading, placement, predict
from ..sources import tables as T

EXAM = "2002-01-20 00:00:00"
SEED = 20240115
SUBJECTS = ["CHI", "ENG", "MATA"]
LOADING = {"CHI": 0.6, "ENG": 0.7, "MATA": 0.5}
SPECS = {
    "w1": {"qualify": [("CHI", 8)], "stages": [(["CHI", "ENG"], 20), (["MATA"], 6)]},
    "w2": {"qualify": [], "stages": [(["MATA"], 5)]},
    "w3": {"qualify": [("ENG", 13), ("MATA", 10)], "stages": [(["CHI", "ENG", "MATA"], 38)]},
}


def _choices(s, d):
    """Choice answers made from line items: keys of 1..5 by arithmetic on their numbers, and some malformed ones."""
    li = T.scan(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("u"), F.col("l_quantity").cast("int").alias("q"))
    got = F.filter(F.array(*[F.when((F.col("q") + i * F.col("n")) % (i + 1) == 0, F.lit(i)) for i in range(1, 6)]), lambda x: x.isNotNull())
    got = F.when(F.col("u") % 17 == 0, F.array(F.lit(0))).when(F.col("u") % 19 == 0, F.lit(None)).otherwise(got)
    want = F.filter(F.array(*[F.when((F.col("p") + i) % 3 == 0, F.lit(i)) for i in range(1, 6)]), lambda x: x.isNotNull())
    return li.select("k", "p", "n", "u", "q", got.alias("got"), want.alias("want"), (F.col("p") % 5 + 1).cast("int").alias("one"))


def grade_single(s, d):
    return _choices(s, d).select("k", "p", "n", "u", "q", G.single_choice("got", F.array("one"), F.lit(5.0)).alias("earned"))


def grade_multi_partial(s, d):
    return _choices(s, d).select("k", "p", "n", "u", "q", G.multi_choice("got", "want", F.lit(5), F.lit(5.0)).alias("earned"))


def _paper(s, d):
    """Papers of twelve parts each, as items of three types; responses are line items of orders, one a part."""
    p = T.scan(s, d, "part")
    paper = lambda key: F.floor(F.col(key) / 12).alias("paper_id")
    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    items = p.select(
        paper("p_partkey"), F.col("p_partkey").alias("question_id"), F.col("p_partkey").cast("int").alias("order"), pick("SINGLE", "MULTI", "ESSAY").alias("type"), F.lit(5.0).alias("score"),
        F.when(F.col("p_partkey") % 3 == 0, F.array((F.col("p_partkey") % 4 + 1).cast("int"))).otherwise(F.array(F.lit(1), (F.col("p_partkey") % 4 + 2).cast("int"))).alias("correct_keys"), F.lit(5).alias("option_count"), (F.col("p_partkey") % 97 == 11).alias("award_all"),
    )
    a = T.answers(s, d).where("is_correct is not null")
    keys = F.when(F.col("is_correct"), F.array(F.lit(1), (F.col("question_id") % 4 + 2).cast("int"))).otherwise(F.array((F.col("question_id") % 4 + 1).cast("int")))
    return items, a.select("attempt_id", paper("question_id"), "question_id", keys.alias("answer_keys"))


def grade_attempt_items(s, d):
    return grading.grade_items(*_paper(s, d)).drop("score")


def grade_attempt_totals(s, d):
    return grading.attempt_totals(grading.grade_items(*_paper(s, d)))


def regrade_diff(s, d):
    a = T.answers(s, d)
    old = a.groupBy("attempt_id").agg(round_half_up(F.sum("earned"), 2).alias("total"))
    new = a.groupBy("attempt_id").agg(round_half_up(F.sum(F.when(F.col("question_id") % 50 == 0, F.col("score")).otherwise(F.col("earned"))), 2).alias("total"))
    return grading.regrade_diff(old, new)


def _samples(s, d):
    e = T.scan(s, d, "events")
    return e.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("answer_id"), (F.col("event_id") % 26).cast("double").alias("suggested_score"), ((F.col("event_id") % 7 + 3) / 10).alias("confidence"), "event_id")


def sample_consensus(s, d):
    return grading.sample_consensus(_samples(s, d), "answer_id")


def _proposals(s, d):
    e = T.scan(s, d, "events")
    state = F.when(F.col("event_type") == "view", "ACCEPTED").when(F.col("event_type").isin("click", "purchase"), "CHANGED").otherwise("PENDING")
    sug = (F.col("event_id") % 21).cast("double")
    return e.select("event_id", (F.col("user_id") % 40).alias("question_id"), state.alias("state"), sug.alias("suggested"), F.when(state == "CHANGED", (F.col("event_id") % 23).cast("double")).otherwise(sug).alias("final"), F.lit(25.0).alias("full"), ((F.col("event_id") % 9) / 10).alias("confidence"), (F.col("event_id") % 11 == 0).alias("unstable"))


def proposal_accuracy(s, d):
    return grading.proposal_accuracy(_proposals(s, d), ["question_id"])


def review_priority(s, d):
    return grading.review_order(_proposals(s, d), "event_id")


def vote_tally(s, d):
    e = T.scan(s, d, "events")
    keys = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("event_id") % 3 + 1).cast("int"), (F.col("event_id") % 2 + 1).cast("int")))
    return grading.vote_tally(e.select(F.floor(F.col("event_id") / 5).alias("question_id"), keys.alias("answer_keys"), F.col("event_id").alias("attempt_idx")), "question_id", 5)


def _claims(s, d):
    g = T.grade_records(s, d).withColumn("k", F.col("exam_name").cast("long"))
    low = (F.col("k") % 12).cast("int")
    return g.select("subject_code", low.alias("interval_low"), (low + F.when(F.col("k") % 41 == 0, -1).otherwise(4)).cast("int").alias("interval_high"), (F.col("k") % 10 / 10 + 0.05).alias("confidence"), F.when(F.col("k") % 6 != 0, F.col("grade")).alias("actual_grade"))


def calibration_curve(s, d):
    return grading.calibration_curve(_claims(s, d), ["subject_code"])


def calibration_counts(s, d):
    return grading.calibration_counts(_claims(s, d), ["subject_code"])


def wilson_interval(s, d):
    t = T.answers(s, d).where("is_correct is not null").groupBy("question_id").agg(F.count_if("is_correct").alias("k"), F.count("*").alias("n"))
    low, high = wilson("k", "n")
    return t.select("question_id", "k", "n", round_half_up(low, 6).alias("low"), round_half_up(high, 6).alias("high"))


_KEYS = ["user_id", "subject_code"]


def predict_weighted(s, d):
    return predict.predict(T.grade_records(s, d), EXAM, _KEYS)


def predict_sources(s, d):
    return predict.source_mix(T.grade_records(s, d), _KEYS)


def predict_distribution(s, d):
    return predict.distribution(predict.predict(T.grade_records(s, d), EXAM, _KEYS), _KEYS)


def predict_interval(s, d):
    return predict.interval(predict_distribution(s, d), _KEYS)


def _class_records(s, d):
    g = T.grade_records(s, d).join(T.users(s, d).select("user_id", "class_id"), "user_id")
    return g.select("class_id", "subject_code", "grade", "exam_date", F.col("exam_name").cast("long").alias("record_id"), F.concat_ws("Q", F.year("exam_date").cast("string"), F.quarter("exam_date").cast("string")).alias("exam_name"))


def pairwise_correlation(s, d):
    return placement.pairwise_correlation(_class_records(s, d), "class_id")


def factor_loadings(s, d):
    return placement.loadings(placement.pairwise_correlation(_class_records(s, d), "class_id"), "class_id")


def reliability_score(s, d):
    o = T.scan(s, d, "orders")
    t = o.select((F.col("o_custkey") % 200).alias("wish_id"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("official"), F.floor(F.col("o_totalprice") / 31250).cast("int").alias("grade"))
    return placement.reliability(t, "wish_id", 2001)


def mulberry32_stream(s, d):
    """The generator's output for each order's number."""
    return T.scan(s, d, "orders").select(F.col("o_orderkey").alias("k"), randoms.uniform(SEED, F.col("o_orderkey")).alias("u"))


def _draws(s, d):
    """A draw for each order, from the grades that the orders of a subject have."""
    o = T.scan(s, d, "orders")
    grades = o.select(F.element_at(F.array(*[F.lit(x) for x in SUBJECTS]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("subject"), F.floor(F.col("o_totalprice") / 31250).cast("int").alias("grade"))
    return placement.draw_grades(o.select(F.col("o_orderkey").alias("draw")), SEED, placement.cumulative(grades, "subject", "grade"), LOADING)


def placement_draws(s, d):
    return _draws(s, d)


def placement_montecarlo(s, d):
    return placement.pass_rates(placement.evaluate(_draws(s, d), SPECS), T.scan(s, d, "orders").count())


def combo_analysis(s, d):
    return placement.combo(placement.evaluate(_draws(s, d), SPECS), T.scan(s, d, "orders").count())


def normal_cdf_table(s, d):
    """The distribution function at a number of hundredths for each order."""
    i = F.col("o_orderkey") % 801 - 400
    return T.scan(s, d, "orders").select("o_orderkey", i.alias("i"), round_half_up(normal_cdf(i / 100.0), 9).alias("p"))


#: Stated verdicts: answer, standard answer, verdict.
TEXT_CASES = [
    ("0.5", "1/2", "SAME"), ("１／２", "0.50", "SAME"), ("−3", "-3", "SAME"), ("1/-2", "-0.5", "SAME"), ("1,234", "1234", "SAME"), ("$\\dfrac{2}{4}$", "1/2", "SAME"), ("3公分", "3.0公分", "SAME"), ("0.5", "1/2|二分之一", "SAME"), ("|x|=3", "|x|=3", "SAME"),
    ("0.333", "1/3", "DIFFERENT"), ("水", "空氣", "DIFFERENT"), ("", "1/2", "DIFFERENT"), ("3公分", "4公分", "DIFFERENT"), ("0.6", "1/2|二分之一", "DIFFERENT"), ("水", "3", "DIFFERENT"),
    ("50%", "0.5", "UNSURE"), ("Co", "CO", "UNSURE"), ("0.03公尺", "3公分|三公分", "UNSURE"), ("√2", "1.414", "UNSURE"), ("一半", "0.5", "UNSURE"), ("三分之二", "1/2|二分之一", "UNSURE"), ("3", "3公分", "UNSURE"), ("1,2", "12", "UNSURE"), ("7", " ", "UNSURE"),
]
#: Stated slots as stored (JSON), standard slots, verdict.
SLOT_CASES = [
    ('["1","2"]', '["1","2"]', "SAME"), ('{"14":"2","13":"1"}', '["1","2"]', "SAME"), ('{"2":"2","10":"1"}', '["2","1"]', "SAME"), ('["−3","０"]', '["-3","0"]', "SAME"), ("12", '["12"]', "SAME"),
    ('["1","3"]', '["1","2"]', "DIFFERENT"), ("[]", '["1","2"]', "DIFFERENT"), ('["",null]', '["1","2"]', "DIFFERENT"), ('["1"]', '["1","2"]', "DIFFERENT"), ('["9","50%"]', '["1","0.5"]', "DIFFERENT"), (None, '["1"]', "DIFFERENT"),
    ('["1","50%"]', '["1","0.5"]', "UNSURE"), ('["1","2","3"]', '["1","2"]', "UNSURE"), ('["1"]', "[]", "UNSURE"), ('["1"]', '["",""]', "UNSURE"),
]
#: Stated units and their forms.
UNIT_CASES = [
    ("m/s²", "m·s^-2"), ("m·s⁻²", "m·s^-2"), ("m s^-2", "m·s^-2"), ("m/s/s", "m·s^-2"), ("J/(kg·K)", "J·K^-1·kg^-1"), ("N·m", "N·m"), ("m·N", "N·m"), ("µm", "μm"), ("米/秒²", "m·s^-2"), ("公里/小時", "hr^-1·km"), ("公斤·米/秒²", "kg·m·s^-2"),
    ("莫耳/公升", "L^-1·mol"), ("立方公分", "cm^3"), ("$\\mathrm{m/s^2}$", "m·s^-2"), ("度", "?度"), ("台尺", "?台尺"), ("每公升  3 大卡", "?每公升 3 大卡"), ("km", "km"), ("", ""), (None, ""), ("%", "%"), ("m·m^-1", ""),
]
#: Stated short answers: text, mode, answer, keywords, score of 4 (null: a person decides).
SHORT_CASES = [
    ("光合 作用", "EXACT", "光合作用", None, 4.0), ("0.5", "EXACT", "1/2|二分之一", None, 4.0), ("呼吸作用", "EXACT", "光合作用", None, 0.0), ("50%", "EXACT", "0.5", None, None), ("x", "EXACT", None, None, None),
    ("葉綠體 行光合作用", "CONTAINS", None, ["葉綠體", "光合 作用"], 4.0), ("葉綠體", "CONTAINS", None, ["葉綠體", "光合"], 0.0), ("", "CONTAINS", None, ["a"], 0.0), ("a", "CONTAINS", None, [], None), ("a", None, "a", ["a"], None),
]


def _cases(cases, key, names):
    """The stated case of each row, by its key."""
    places = [F.struct(*[(F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, case, strict=False)]) for case in cases]
    kind = ", ".join(f"{n}: {'array<string>' if n == 'keywords' else 'string'}" for n in names)
    return F.element_at(F.array(*[p.cast(f"struct<{kind}>") for p in places]), (F.col(key) % len(cases) + 1).cast("int"))


def grade_fill_text(s, d):
    """Each line item with a stated answer and standard answer."""
    li = T.scan(s, d, "lineitem").select("l_orderkey", "l_linenumber", _cases(TEXT_CASES, "l_partkey", ["got", "want"]).alias("c"))
    return li.select("l_orderkey", "l_linenumber", A.same_text("c.got", "c.want").alias("verdict"))


def grade_fill_slots(s, d):
    o = T.scan(s, d, "orders").select("o_orderkey", _cases(SLOT_CASES, "o_orderkey", ["got", "want"]).alias("c"))
    return o.select("o_orderkey", A.same_slots(A.slot_list("c.got"), A.slot_list("c.want")).alias("verdict"))


def grade_short_answer(s, d):
    c = T.scan(s, d, "customer").select("c_custkey", _cases(SHORT_CASES, "c_custkey", ["text", "mode", "answer", "keywords"]).alias("c")).select("c_custkey", "c.*")
    return c.select("c_custkey", G.short_answer("text", "mode", "answer", "keywords", F.lit(4)).alias("earned"))


def unit_normalise(s, d):
    p = T.scan(s, d, "part").select("p_partkey", _cases(UNIT_CASES, "p_partkey", ["unit"]).alias("c"))
    return p.select("p_partkey", A.unit_form("c.unit").alias("form"))


NAMES = [
    grade_single, grade_multi_partial, grade_attempt_items, grade_attempt_totals, regrade_diff, sample_consensus, proposal_accuracy, review_priority, vote_tally, calibration_curve, calibration_counts, wilson_interval, predict_weighted,
    predict_sources, predict_distribution, predict_interval, pairwise_correlation, factor_loadings, reliability_score, mulberry32_stream, placement_draws, placement_montecarlo, combo_analysis, normal_cdf_table, grade_fill_slots, grade_short_answer, grade_fill_text, unit_normalise,
]
QUERIES = {f.__name__: f for f in NAMES}

_CHOICES = """choices AS (SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n, l_suppkey AS u, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem),
keyed AS (SELECT *, CASE WHEN u % 17 = 0 THEN [0] WHEN u % 19 = 0 THEN []::INT[] ELSE list_filter([1, 2, 3, 4, 5], lambda i: (q + i * n) % (i + 1) = 0) END AS got,
  list_filter([1, 2, 3, 4, 5], lambda i: (p + i) % 3 = 0) AS want, p % 5 + 1 AS one FROM choices)"""
_PAPER = """items AS (SELECT p_partkey AS question_id, CAST(p_partkey AS INT) AS "order", (['SINGLE', 'MULTI', 'ESSAY'])[p_partkey % 3 + 1] AS type, p_partkey % 97 = 11 AS award,
  CASE WHEN p_partkey % 3 = 0 THEN [p_partkey % 4 + 1] ELSE [1, p_partkey % 4 + 2] END AS want, p_partkey // 12 AS paper_id FROM part),
resp AS (SELECT attempt_id, question_id, CASE WHEN is_correct THEN [1, question_id % 4 + 2] ELSE [question_id % 4 + 1] END AS got FROM answers WHERE is_correct IS NOT NULL),
cells AS (SELECT a.attempt_id, i.*, r.got, coalesce(len(r.got) > 0, false) AS answered, len(list_filter(i.want, lambda x: NOT list_contains(coalesce(r.got, []), x))) + len(list_filter(coalesce(r.got, []), lambda x: NOT list_contains(i.want, x))) AS off
  FROM (SELECT DISTINCT attempt_id, question_id // 12 AS paper_id FROM resp) a JOIN items i ON i.paper_id = a.paper_id LEFT JOIN resp r ON r.attempt_id = a.attempt_id AND r.question_id = i.question_id),
marked AS (SELECT *, CASE type WHEN 'SINGLE' THEN CASE WHEN len(want) <> 1 THEN NULL WHEN coalesce(len(got), 0) <> 1 THEN 0.0 WHEN got[1] = want[1] THEN 5.0 ELSE 0.0 END
  WHEN 'MULTI' THEN CASE WHEN coalesce(len(got), 0) = 0 THEN 0.0 WHEN list_max(got) > 5 OR list_max(want) > 99 THEN NULL WHEN off = 0 THEN 5.0 ELSE floor(5.0 * greatest(5 - 2 * off, 0) / 5 * 1e6 + 0.5) / 1e6 END END AS auto FROM cells),
graded AS (SELECT attempt_id, question_id, "order", type, answered, CASE WHEN award THEN 5.0 ELSE auto END AS earned, CASE WHEN NOT answered THEN 'BLANK' WHEN auto IS NULL THEN 'PENDING' WHEN auto >= 5 THEN 'CORRECT' WHEN auto > 0 THEN 'PARTIAL' ELSE 'WRONG' END AS verdict FROM marked)"""
_SAMPLES = """samples AS (SELECT user_id * 100 + day(ts) AS answer_id, CAST(event_id % 26 AS DOUBLE) AS s, (event_id % 7 + 3) / 10 AS c FROM events),
mid AS (SELECT answer_id, count(*) AS n, quantile_cont(s, 0.5) AS median, max(s) - min(s) AS spread, avg(c) AS mean FROM samples GROUP BY 1),
near AS (SELECT m.answer_id, (min((abs(s - median), s)))[2] AS representative FROM samples x JOIN mid m ON m.answer_id = x.answer_id GROUP BY 1)"""
_PROPOSALS = """proposals AS (SELECT event_id, user_id % 40 AS question_id, CASE WHEN event_type = 'view' THEN 'ACCEPTED' WHEN event_type IN ('click', 'purchase') THEN 'CHANGED' ELSE 'PENDING' END AS state, CAST(event_id % 21 AS DOUBLE) AS suggested,
  CASE WHEN event_type IN ('click', 'purchase') THEN CAST(event_id % 23 AS DOUBLE) ELSE CAST(event_id % 21 AS DOUBLE) END AS final, event_id % 9 / 10 AS confidence, event_id % 11 = 0 AS unstable FROM events)"""
_CLAIMS = """claims AS (SELECT subject_code, CAST(k % 12 AS INT) AS lo, CAST(k % 12 + CASE WHEN k % 41 = 0 THEN -1 ELSE 4 END AS INT) AS hi, k % 10 / 10 + 0.05 AS c, CASE WHEN k % 6 <> 0 THEN grade END AS g FROM (SELECT *, CAST(exam_name AS BIGINT) AS k FROM grade_records))"""
_PREDICT = """dated AS (SELECT *, epoch(exam_date) / 86400.0 AS day, max(epoch(exam_date) / 86400.0) OVER (PARTITION BY user_id, subject_code) AS newest FROM grade_records),
weighed AS (SELECT *, day - newest AS t, pow(0.5, (newest - day) / 120.0) AS w, CASE source WHEN 'OFFICIAL_GSAT' THEN 0.0 WHEN 'EXTERNAL_MOCK' THEN 0.7 WHEN 'INTERNAL_MOCK' THEN 0.7 ELSE 0.9 END AS u,
  CASE source WHEN 'OFFICIAL_GSAT' THEN 0.0 WHEN 'EXTERNAL_MOCK' THEN 0.4 WHEN 'INTERNAL_MOCK' THEN 1.1 ELSE 1.3 END AS v FROM dated),
sums AS (SELECT user_id, subject_code, count(*) AS records, max(newest) AS newest, sum(w) AS sw1, sum(w * w) AS sw2, sum(w * t) / sum(w) AS anchor, sum(w * grade) / sum(w) AS mean, sum(w * u * u) / sum(w) + sum(w * v * v) / sum(w) AS src FROM weighed GROUP BY 1, 2),
second AS (SELECT s.user_id, s.subject_code, any_value(records) AS records, any_value(mean) AS mean, any_value(sw1) AS sw, any_value(sw1 * sw1 / sw2) AS n_eff, any_value(src) AS src, greatest(0.0, (epoch(TIMESTAMP '2002-01-20') / 86400.0 - any_value(s.newest) - any_value(anchor)) / 30.4375) AS months,
  sum(x.w * (x.grade - mean) * (x.grade - mean)) AS ss, sum(x.w * pow((x.t - anchor) / 30.4375, 2)) AS sxx, sum(x.w * (x.t - anchor) / 30.4375 * x.grade) AS sxy FROM sums s JOIN weighed x ON x.user_id = s.user_id AND x.subject_code = s.subject_code GROUP BY 1, 2),
third AS (SELECT *, CASE WHEN n_eff > 1 + 1e-9 THEN ss / sw / (1 - 1 / n_eff) ELSE 1.44 END AS var, greatest(0.0, n_eff - 1) AS df, CASE WHEN n_eff > 2 THEN (n_eff - 2) / n_eff ELSE 0.0 END AS k FROM second),
fourth AS (SELECT *, sqrt((df * var + 2 * 1.44) / (df + 2) * (1 + 1 / n_eff) + src + 0.2025 * months) AS down, coalesce(k * CASE WHEN sxx > 1e-9 THEN sxy / sxx END + (1 - k) * 0.15, 0.15) AS per_month FROM third),
predicted AS (SELECT user_id, subject_code, records, floor(n_eff * 1000 + 0.5) / 1000 AS n_eff, floor(mean * 1000 + 0.5) / 1000 AS weighted_mean, floor(months * 100 + 0.5) / 100 AS months_ahead,
  CASE WHEN records >= 3 THEN floor(least(15.0, greatest(0.0, mean + least(3.0, greatest(-3.0, per_month * months)))) * 10000 + 0.5) / 10000 END AS center, CASE WHEN records >= 3 THEN floor(down * 10000 + 0.5) / 10000 END AS sd_down,
  CASE WHEN records >= 3 THEN floor(down * (1 + least(0.5, 0.06 * months)) * 10000 + 0.5) / 10000 END AS sd_up FROM fourth)"""


def _sql_cdf(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / sqrt(2)))"
    e = f"(1.0 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))"
    return f"(0.5 * (1.0 + CASE WHEN {z} < 0 THEN -{e} ELSE {e} END))"


def _sql_split(x: str) -> str:
    return f"(CASE WHEN {x} <= center THEN 2.0 * sd_down / (sd_down + sd_up) * {_sql_cdf(f'(({x} - center) / sd_down)')} ELSE sd_down / (sd_down + sd_up) + sd_up / (sd_down + sd_up) * (2.0 * {_sql_cdf(f'(({x} - center) / sd_up)')} - 1.0) END)"


_DIST = _PREDICT + f""",
mass AS (SELECT user_id, subject_code, grade, greatest(0.0, CASE WHEN grade = 15 THEN 1.0 ELSE {_sql_split("(grade + 0.5)")} END - CASE WHEN grade = 0 THEN 0.0 ELSE {_sql_split("(grade - 0.5)")} END) AS p FROM predicted CROSS JOIN (SELECT unnest(range(16)) AS grade) WHERE center IS NOT NULL),
dist AS (SELECT user_id, subject_code, CAST(grade AS INT) AS grade, floor(p / sum(p) OVER (PARTITION BY user_id, subject_code) * 1e6 + 0.5) / 1e6 AS p FROM mass)"""
_RUNS = _DIST + """,
cum AS (SELECT *, floor(sum(p) OVER (PARTITION BY user_id, subject_code ORDER BY grade) * 1e6 + 0.5) / 1e6 AS upto FROM dist),
runs AS (SELECT a.user_id, a.subject_code, a.grade AS lo, b.grade AS hi, floor((b.upto - a.upto + a.p) * 1e6 + 0.5) / 1e6 AS cov FROM cum a JOIN cum b ON a.user_id = b.user_id AND a.subject_code = b.subject_code AND a.grade <= b.grade),
best AS (SELECT * FROM runs WHERE cov + 1e-9 >= 0.7 QUALIFY row_number() OVER (PARTITION BY user_id, subject_code ORDER BY hi - lo, cov DESC, lo) = 1),
wide AS (SELECT b.*, lo = hi AS widened, coalesce((SELECT p FROM dist d WHERE d.user_id = b.user_id AND d.subject_code = b.subject_code AND d.grade = hi + 1), -1) >= coalesce((SELECT p FROM dist d WHERE d.user_id = b.user_id AND d.subject_code = b.subject_code AND d.grade = lo - 1), -1) AS up FROM best b),
ends AS (SELECT user_id, subject_code, CASE WHEN widened AND NOT up THEN lo - 1 ELSE lo END AS low, CASE WHEN widened AND up THEN hi + 1 ELSE hi END AS high, widened FROM wide)"""
_CORR = """recs AS (SELECT class_id, subject_code, grade, exam_date, CAST(exam_name AS BIGINT) AS record_id, CAST(year(exam_date) AS VARCHAR) || 'Q' || CAST(quarter(exam_date) AS VARCHAR) AS exam FROM grade_records JOIN users USING (user_id)),
means AS (SELECT class_id, subject_code, avg(grade) AS mean FROM recs GROUP BY 1, 2),
resid AS (SELECT r.class_id, r.subject_code, r.exam, grade - mean AS d FROM (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY class_id, subject_code, exam ORDER BY exam_date DESC, record_id DESC) = 1) r JOIN means m ON m.class_id = r.class_id AND m.subject_code = r.subject_code),
sums AS (SELECT a.class_id, a.subject_code AS a, b.subject_code AS b, count(*) AS n, sum(a.d * a.d) AS sxx, sum(b.d * b.d) AS syy, sum(a.d * b.d) AS sxy FROM resid a JOIN resid b ON a.class_id = b.class_id AND a.exam = b.exam AND a.subject_code < b.subject_code GROUP BY 1, 2, 3),
rs AS (SELECT m.class_id, m.subject_code AS a, o.subject_code AS b, coalesce(n, 0) AS common_exams, CASE WHEN n >= 4 AND sxx > 1e-9 AND syy > 1e-9 THEN greatest(-1, least(1, sxy / sqrt(sxx * syy))) END AS r
  FROM means m JOIN means o ON m.class_id = o.class_id AND m.subject_code < o.subject_code LEFT JOIN sums s ON s.class_id = m.class_id AND s.a = m.subject_code AND s.b = o.subject_code),
pairs AS (SELECT class_id, a, b, common_exams, floor(r * 10000 + 0.5) / 10000 AS observed, floor(coalesce(r, 0.4) * 10000 + 0.5) / 10000 AS used FROM rs)"""
_M = "4294967295"


def _sql_mul(a: str, b: str) -> str:
    return f"(({a} * ({b} & 65535) + ((({a} * ({b} >> 16)) & {_M}) << 16)) & {_M})"


_UNIFORM = f"""k0 AS (SELECT k, ({SEED} + {_sql_mul("1831565813::BIGINT", "(k + 1)")}) & {_M} AS a FROM ks),
k1 AS (SELECT k, {_sql_mul("xor(a, a >> 15)", "(a | 1)")} AS t FROM k0),
k2 AS (SELECT k, xor((t + {_sql_mul("xor(t, t >> 7)", "(t | 61)")}) & {_M}, t) AS t FROM k1),
uniforms AS (SELECT k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM k2)"""


def _sql_draws() -> str:
    m = 1 + len(SUBJECTS)
    us = ", ".join(f"{_sql_cdf(f'({LOADING[n]} * z0 + {max(0.0, 1 - LOADING[n] * LOADING[n]) ** 0.5!r} * z{i + 1})')} AS u_{n}" for i, n in enumerate(SUBJECTS))
    grades = ", ".join(f"CAST(len(list_filter((SELECT at FROM steps WHERE subject = '{n}'), lambda s: s < u_{n})) AS INT) AS {n}" for n in SUBJECTS)
    zs = ", ".join(f"max(z) FILTER (j = {j}) AS z{j}" for j in range(m))
    return f"""seen AS (SELECT ([{', '.join(f"'{n}'" for n in SUBJECTS)}])[o_custkey % 3 + 1] AS subject, least(CAST(floor(o_totalprice / 31250) AS INT), 15) AS grade FROM orders),
steps AS (SELECT subject, list(upto / whole ORDER BY g) AS "at" FROM (SELECT subject, g, CAST(count(*) FILTER (grade <= g) AS DOUBLE) AS upto, CAST(count(*) AS DOUBLE) AS whole FROM seen, range(15) r(g) GROUP BY 1, 2) GROUP BY 1),
ks AS (SELECT o_orderkey * {2 * m} + i AS k FROM orders, range({2 * m}) r(i)),
{_UNIFORM},
normals AS (SELECT a.k // {2 * m} AS draw, a.k % {2 * m} // 2 AS j, sqrt(-2 * ln(greatest(1e-12, a.u))) * cos(2 * pi() * b.u) AS z FROM uniforms a JOIN uniforms b ON b.k = a.k + 1 WHERE a.k % 2 = 0),
zs AS (SELECT draw, {zs} FROM normals GROUP BY 1), us AS (SELECT draw, {us} FROM zs), draws AS (SELECT draw, {grades.replace('SELECT at', 'SELECT "at"')} FROM us)"""


def _sql_results() -> str:
    rows = []
    for w, s in SPECS.items():
        whens = [f"WHEN {x} < {n} THEN 'QUALIFY'" for x, n in s["qualify"]] + [f"WHEN {' + '.join(x)} < {n} THEN 'SIEVE{i}'" for i, (x, n) in enumerate(s["stages"])]
        rows.append(f"SELECT draw, '{w}' AS wish, CASE {' '.join(whens)} END AS cause FROM draws")
    return _sql_draws() + ",\nresults AS (" + " UNION ALL ".join(rows) + ")"


def _stated(cases, table, key, name, *keys):
    """The last entry of the stated case of each row."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT {', '.join(keys)}, ([{', '.join(literal(c[-1]) for c in cases)}])[{key} % {len(cases)} + 1] AS {name} FROM {table}"


ORACLES = {
    "grade_fill_text": _stated(TEXT_CASES, "lineitem", "l_partkey", "verdict", "l_orderkey", "l_linenumber"),
    "grade_fill_slots": _stated(SLOT_CASES, "orders", "o_orderkey", "verdict", "o_orderkey"),
    "grade_short_answer": _stated(SHORT_CASES, "customer", "c_custkey", "earned", "c_custkey"),
    "unit_normalise": _stated(UNIT_CASES, "part", "p_partkey", "form", "p_partkey"),
    "grade_single": T.sql("SELECT k, p, n, u, q, CASE WHEN u % 17 = 0 THEN NULL WHEN len(got) <> 1 THEN 0.0 WHEN got[1] = one THEN 5.0 ELSE 0.0 END AS earned FROM keyed", extra=_CHOICES),
    "grade_multi_partial": T.sql(
        """SELECT k, p, n, u, q, CASE WHEN u % 17 = 0 OR len(want) = 0 THEN NULL WHEN len(got) = 0 THEN 0.0 WHEN off = 0 THEN 5.0 ELSE floor(5.0 * greatest(5 - 2 * off, 0) / 5 * 1e6 + 0.5) / 1e6 END AS earned FROM (
  SELECT *, len(list_filter(want, lambda x: NOT list_contains(got, x))) + len(list_filter(got, lambda x: NOT list_contains(want, x))) AS off FROM keyed)""", extra=_CHOICES),
    "grade_attempt_items": T.sql("SELECT * FROM graded", "answers", extra=_PAPER),
    "grade_attempt_totals": T.sql(
        """SELECT attempt_id, count(*) AS items, floor(sum(earned) * 1e6 + 0.5) / 1e6 AS auto, sum(5.0) FILTER (earned IS NOT NULL) AS auto_max, count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) FILTER (verdict = 'PENDING') AS pending,
  CASE WHEN count(*) FILTER (verdict = 'PENDING') = 0 THEN 'GRADED' ELSE 'SUBMITTED' END AS status FROM graded GROUP BY 1""", "answers", extra=_PAPER),
    "regrade_diff": T.sql(
        """SELECT * FROM (SELECT attempt_id, floor(sum(earned) * 100 + 0.5) / 100 AS before, floor(sum(CASE WHEN question_id % 50 = 0 THEN score ELSE earned END) * 100 + 0.5) / 100 AS after FROM answers GROUP BY 1) WHERE before IS DISTINCT FROM after""", "answers"),
    "sample_consensus": T.sql(
        """SELECT answer_id, n, median, floor(spread * 1e6 + 0.5) / 1e6 AS spread, unstable, representative, floor(least(0.95, greatest(0.02, CASE WHEN unstable THEN least(c, 0.4) ELSE c END)) * 10000 + 0.5) / 10000 AS confidence FROM (
  SELECT m.*, spread / 25 > 0.15 AS unstable, representative, mean * (1 - spread / 25) * CASE WHEN n = 1 THEN 0.7 ELSE 1.0 END AS c FROM mid m JOIN near USING (answer_id))""", extra=_SAMPLES),
    "proposal_accuracy": T.sql(
        """SELECT question_id, count(*) AS n, count(*) FILTER (state <> 'PENDING') AS decided, count(*) FILTER (state = 'ACCEPTED') AS accepted, count(*) FILTER (state = 'CHANGED') AS changed, floor(avg(abs(final - suggested)) FILTER (state <> 'PENDING') * 10000 + 0.5) / 10000 AS mae,
  floor(avg(abs(final - suggested)) FILTER (state = 'CHANGED') * 10000 + 0.5) / 10000 AS mae_changed, floor(avg(final - suggested) FILTER (state <> 'PENDING') * 10000 + 0.5) / 10000 AS bias, floor(avg(abs(final - suggested) / 25) FILTER (state <> 'PENDING') * 10000 + 0.5) / 10000 AS relative,
  floor(count(*) FILTER (state = 'ACCEPTED') / nullif(count(*) FILTER (state <> 'PENDING'), 0) * 10000 + 0.5) / 10000 AS adoption, count(*) FILTER (state <> 'PENDING') >= 20 AS enough FROM proposals GROUP BY 1""", extra=_PROPOSALS),
    "review_priority": T.sql(
        """SELECT event_id, question_id, pr AS priority, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pr, event_id) AS INT) AS position FROM (SELECT *, CASE WHEN state <> 'PENDING' THEN 10.0 WHEN suggested IS NULL THEN -2.0 WHEN unstable THEN -1.0 ELSE confidence END AS pr FROM proposals)""", extra=_PROPOSALS),
    "vote_tally": """WITH v AS (SELECT event_id // 5 AS question_id, event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([event_id % 3 + 1, event_id % 2 + 1])), ',') END AS answer FROM events),
best AS (SELECT question_id, answer, count(*) AS n, min(event_id) AS f FROM v GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, min(event_id)) = 1),
w AS (SELECT question_id, answer, CASE WHEN answer = '' THEN 0 ELSE n END AS votes FROM best)
SELECT question_id, answer, votes, floor(votes / 5 * 10000 + 0.5) / 10000 AS consistency, CASE WHEN votes / 5 >= 0.99 THEN 'high' WHEN votes / 5 >= 0.6 THEN 'mid' ELSE 'low' END AS tier, votes / 5 >= 0.6 AS autofill FROM w""",
    "calibration_curve": T.sql(
        """SELECT subject_code, CAST(band AS INT) AS band, n, hit, CASE WHEN n > 0 THEN floor(hit / n * 10000 + 0.5) / 10000 END AS hit_rate, floor(claimed * 10000 + 0.5) / 10000 AS claimed, floor(low * 10000 + 0.5) / 10000 AS low, floor(high * 10000 + 0.5) / 10000 AS high,
  CASE WHEN n >= 10 AND claimed - hit / n > 0.15 AND high < claimed THEN 'OVER' WHEN n >= 10 AND hit / n - claimed > 0.15 AND low > claimed THEN 'UNDER' END AS alert FROM (
  SELECT *, CASE WHEN n > 0 THEN greatest(0, (hit / n + 3.8416 / (2 * n) - 1.96 * sqrt(hit / n * (1 - hit / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) END AS low, CASE WHEN n > 0 THEN least(1, (hit / n + 3.8416 / (2 * n) + 1.96 * sqrt(hit / n * (1 - hit / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) END AS high FROM (
  SELECT s.subject_code, b.band, count(c.c) AS n, count(*) FILTER (g BETWEEN lo AND hi) AS hit, avg(c.c) AS claimed FROM (SELECT DISTINCT subject_code FROM claims) s CROSS JOIN (SELECT unnest(range(5)) AS band) b
  LEFT JOIN (SELECT *, CASE WHEN c < 0.5 THEN 0 WHEN c < 0.6 THEN 1 WHEN c < 0.7 THEN 2 WHEN c < 0.8 THEN 3 ELSE 4 END AS band FROM claims WHERE lo <= hi AND c > 0 AND c <= 1 AND g IS NOT NULL) c ON c.subject_code = s.subject_code AND c.band = b.band GROUP BY 1, 2))""", "grade_records", extra=_CLAIMS),
    "calibration_counts": T.sql("SELECT subject_code, count(*) FILTER (NOT (lo <= hi AND c > 0 AND c <= 1)) AS malformed, count(*) FILTER (lo <= hi AND c > 0 AND c <= 1 AND g IS NULL) AS pending, count(*) FILTER (lo <= hi AND c > 0 AND c <= 1 AND g IS NOT NULL) AS known FROM claims GROUP BY 1", "grade_records", extra=_CLAIMS),
    "wilson_interval": T.sql(
        """SELECT question_id, k, n, floor(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) * 1e6 + 0.5) / 1e6 AS low, floor(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) * 1e6 + 0.5) / 1e6 AS high
  FROM (SELECT question_id, count(*) FILTER (is_correct) AS k, count(*) AS n FROM answers WHERE is_correct IS NOT NULL GROUP BY 1)""", "answers"),
    "predict_weighted": T.sql("SELECT * FROM predicted", "grade_records", extra=_PREDICT),
    "predict_sources": T.sql("SELECT user_id, subject_code, source, count(*) AS n, floor(sum(w) / any_value(tw) * 10000 + 0.5) / 10000 AS weight_share FROM (SELECT *, sum(w) OVER (PARTITION BY user_id, subject_code) AS tw FROM weighed) GROUP BY 1, 2, 3", "grade_records", extra=_PREDICT),
    "predict_distribution": T.sql("SELECT * FROM dist", "grade_records", extra=_DIST),
    "predict_interval": T.sql(
        "SELECT e.user_id, e.subject_code, low, high, widened, least(0.99, floor((SELECT floor(sum(p) * 1e6 + 0.5) / 1e6 FROM dist d WHERE d.user_id = e.user_id AND d.subject_code = e.subject_code AND d.grade BETWEEN low AND high) * 100 + 0.5) / 100) AS confidence FROM ends e", "grade_records", extra=_RUNS),
    "pairwise_correlation": T.sql("SELECT * FROM pairs", "grade_records", "users", extra=_CORR),
    "factor_loadings": T.sql(
        """SELECT class_id, subject_code, floor(sqrt(greatest(0, least(0.9, avg(used)))) * 10000 + 0.5) / 10000 AS loading, any_value(source) AS source FROM (SELECT class_id, unnest([a, b]) AS subject_code, used FROM pairs) p
  JOIN (SELECT class_id, CASE WHEN count(observed) = count(*) THEN 'OWN' WHEN count(observed) > 0 THEN 'MIXED' ELSE 'DEFAULT' END AS source FROM pairs GROUP BY 1) s USING (class_id) GROUP BY 1, 2""", "grade_records", "users", extra=_CORR),
    "reliability_score": """SELECT wish_id, years, score, CASE WHEN score < 0.4 THEN 'NO_ESTIMATE' WHEN score < 0.7 THEN 'HIGH_UNCERTAINTY' ELSE 'NORMAL' END AS tier FROM (SELECT wish_id, years,
  floor((CASE least(years, 3) WHEN 0 THEN 0.3 WHEN 1 THEN 0.55 WHEN 2 THEN 0.8 ELSE 1.0 END)::DOUBLE * (CASE 2001 - last WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.78 WHEN 3 THEN 0.62 ELSE 0.45 END)::DOUBLE * greatest(0.5, 1 - coalesce(sd, 0) / 6) * 10000 + 0.5) / 10000 AS score FROM (
  SELECT o_custkey % 200 AS wish_id, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) END) AS years, max(year(o_orderdate)) AS last, stddev_samp(CAST(floor(o_totalprice / 31250) AS INT)) AS sd FROM orders GROUP BY 1))""",
    "mulberry32_stream": f"WITH ks AS (SELECT o_orderkey AS k FROM orders),\n{_UNIFORM}\nSELECT k, u FROM uniforms",
    "placement_draws": f"WITH {_sql_draws()}\nSELECT * FROM draws",
    "placement_montecarlo": f"WITH {_sql_results()}\nSELECT wish, passes, failed_qualify, failed_sieve, floor(passes / (SELECT count(*) FROM orders) * 10000 + 0.5) / 10000 AS rate, CASE WHEN passes / (SELECT count(*) FROM orders) < 0.3 THEN 'SPRINT' WHEN passes / (SELECT count(*) FROM orders) > 0.7 THEN 'SAFE' ELSE 'STEADY' END AS risk FROM (SELECT wish, count(*) FILTER (cause IS NULL) AS passes, count(*) FILTER (cause = 'QUALIFY') AS failed_qualify, count(*) FILTER (cause LIKE 'SIEVE%') AS failed_sieve FROM results GROUP BY 1)",
    "combo_analysis": f"WITH {_sql_results()}\nSELECT passed, count(*) AS draws, floor(count(*) / (SELECT count(*) FROM orders) * 10000 + 0.5) / 10000 AS share FROM (SELECT draw, CAST(count(*) FILTER (cause IS NULL) AS INT) AS passed FROM results GROUP BY 1) GROUP BY 1",
    "normal_cdf_table": f"SELECT o_orderkey, i, floor({_sql_cdf('(i / 100.0::DOUBLE)')} * 1e9 + 0.5) / 1e9 AS p FROM (SELECT o_orderkey, o_orderkey % 801 - 400 AS i FROM orders)",
}
