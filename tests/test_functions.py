"""Column and scalar functions against stated values."""

from __future__ import annotations

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gradelake.functions import answers as A
from gradelake.functions import grading as G
from gradelake.functions import randoms
from gradelake.functions import text as X
from gradelake.functions.numeric import erf, normal_cdf, round_bankers, round_half_up, wilson
from gradelake.plans import grading as PG
from gradelake.operators import mastery, notify, placement, predict, roster, stats


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def keys(*k):
    return F.array(*[F.lit(x) for x in k]).cast("array<int>")


@pytest.mark.parametrize(("got", "want", "n", "score", "earned"), [([1, 2, 3], [1, 2, 3], 5, 5, 5.0), ([1, 2], [1, 2, 3], 5, 5, 3.0), ([1, 2, 3, 4], [1, 2, 3], 5, 5, 3.0), ([1, 4], [1, 2, 3], 5, 5, 0.0), ([1, 2, 3, 4], [1, 2], 4, 4, 0.0), ([], [1, 2], 5, 5, 0.0), ([0], [1, 2], 5, 5, None), ([6], [1, 2], 5, 5, None)])
def test_multi_choice(spark, got, want, n, score, earned):
    assert one(spark, x=G.multi_choice(keys(*got), keys(*want), F.lit(n), F.lit(score)))["x"] == earned


def test_single_choice_and_verdict(spark):
    r = one(spark, a=G.single_choice(keys(2), keys(2), F.lit(4)), b=G.single_choice(keys(1, 2), keys(2), F.lit(4)), c=G.single_choice(keys(), keys(2), F.lit(4)), d=G.single_choice(keys(2), keys(1, 2), F.lit(4)))
    assert tuple(r) == (4.0, 0.0, 0.0, None)
    v = one(spark, a=G.verdict(F.lit(False), F.lit(1.0), F.lit(2.0)), b=G.verdict(F.lit(True), F.lit(None).cast("double"), F.lit(2.0)), c=G.verdict(F.lit(True), F.lit(1.0), F.lit(2.0)))
    assert tuple(v) == ("BLANK", "PENDING", "PARTIAL")


def test_short_answer_rules(spark):
    kw = F.array(F.lit("ab"), F.lit("cd"))
    f = lambda text, mode: G.short_answer(F.lit(text), F.lit(mode), F.lit("ab cd"), kw, F.lit(4))
    assert tuple(one(spark, a=f("x ab, cd", "CONTAINS"), b=f("ab only", "CONTAINS"), c=f("ab cd ", "EXACT"), d=f("ab", None))) == (4.0, 0.0, 4.0, None)


def test_rationals_and_units():
    for got, want, verdict in PG.TEXT_CASES:
        assert A.fill_text(got, want) == verdict, (got, want)
    assert A.compare("-0", "0") == A.compare("½", "0.5") == A.compare("0.5.", "0.5") == A.SAME
    assert A.compare("", "√2") == A.DIFFERENT and A.compare(" ", "") == A.SAME
    assert A.compare(r"\frac{\sqrt{2}}{2}", "0.707") == A.compare("1/0", "2") == A.UNSURE
    assert A.rational("-3.25") == (Fraction(-13, 4), "") and A.rational("3.5 公分") == (Fraction(7, 2), "公分") and A.rational("3x4") is None
    assert A.alternatives("a|b") == ["a", "b"] and A.alternatives("a|") == ["a|"] and A.alternatives(" ") == []
    for unit, form in PG.UNIT_CASES:
        assert A.normal_unit(unit) == form, unit
    assert A.same_unit(None, "N") and not A.same_unit("km", "m") and not A.same_unit("N", "kg·m/s^2")


def test_rounding(spark):
    r = one(spark, a=round_half_up(F.lit(-2.5)), b=round_half_up(F.lit(2.5)), c=round_bankers(F.lit(2.5)), d=round_half_up(F.lit(1.005), 2))
    assert tuple(r) == (-2.0, 3.0, 2.0, 1.0)


def test_normal_and_wilson(spark):
    low, high = wilson(F.lit(0), F.lit(10))
    low2, high2 = wilson(F.lit(10), F.lit(10))
    r = one(spark, e=erf(F.lit(1.0)), p=normal_cdf(F.lit(0.0)), low=low, high=high, low2=low2, none=wilson(F.lit(0), F.lit(0))[0])
    assert abs(r["e"] - 0.8427007929) < 2e-7
    assert abs(r["p"] - 0.5) < 1e-8
    assert r["low"] == 0.0 and r["high"] > 0.2 and r["low2"] < 1 and r["none"] is None


def test_generator_is_the_sequential_one(spark):
    got = [r["u"] for r in spark.range(200).select("id", randoms.uniform(12345, F.col("id")).alias("u")).orderBy("id").collect()]
    assert got == randoms.python_uniforms(12345, 200)
    assert randoms.seed_from("") == 0x811C9DC5


def test_placement_replays_with_its_seed(spark):
    marginals = {"A": [0.0] * 8 + [0.25] * 4 + [0.0] * 4, "B": [1 / 16] * 16}
    steps = {k: [sum(v[: i + 1]) for i in range(len(v) - 1)] for k, v in marginals.items()}
    run = lambda: placement.pass_rates(placement.evaluate(placement.draw_grades(spark.range(500).withColumnRenamed("id", "draw"), 7, steps, {"A": 0.5, "B": 0.5}), {"w": {"qualify": [("A", 9)], "stages": [(["A", "B"], 15)]}}), 500).collect()
    assert run() == run()


def test_decay(spark):
    r = one(spark, a=mastery.decay_weight(F.lit(0.0), F.lit(0.05)), b=mastery.decay_weight(F.lit(999.0), F.lit(0.0)), c=mastery.decay_weight(F.lit(97.0406), F.lit(0.05)), d=mastery.decay_weight(F.lit(-5.0), F.lit(0.05)))
    assert r["a"] == 1.0 and r["b"] == 1.0 and abs(r["c"] - 0.5) < 1e-5 and r["d"] == 1.0


def test_text_functions(spark):
    r = one(spark, k=X.content_key(F.lit("(3). Ａｂ，c！ 1")), o=X.own_share(F.lit("abcdefgh"), F.lit("xxabcdef")), short=X.own_share(F.lit("abc"), F.lit("abc")), t=X.search_term(F.lit("   ")), h=X.strip_html(F.lit("<p>a<script>x<y</script> b&amp;</p><!-- c -->")))
    assert r["k"] == "Abc1"
    assert r["o"] == pytest.approx(3 / 5)
    assert r["short"] == 0.0 and r["t"] is None and r["h"] == "a b&amp;"
    assert spark.createDataFrame([("50%_x",), ("50ax",)], "s string").where(X.like_literal("s", "%_")).count() == 1


def test_peer_means_take_the_latest_attempt(spark):
    rows = [("e", "busy", 0.0, 1), ("e", "busy", 0.0, 2), ("e", "busy", 90.0, 3), ("e", "b", 70.0, 1), ("e", "c", 80.0, 1), ("e", "d", None, 1)]
    got = stats.peer_means(spark.createDataFrame(rows, "assignment_id string, user_id string, total_score double, attempt_no int"), min_peers=3).first()
    assert (got["peers"], got["peer_mean"]) == (3, 80.0)


@pytest.mark.parametrize(("policy", "status", "due", "released", "level"), [("ON_DUE", "GRADED", "2024-01-01 00:00:00", None, "SCORE_ONLY"), ("ON_DUE", "GRADED", "2023-12-31 23:59:59", None, "FULL"), ("ON_DUE", "GRADED", None, None, "SCORE_ONLY"), ("MANUAL", "GRADED", None, None, "NONE"), ("MANUAL", "GRADED", None, "2024-01-01 00:00:00", "FULL"), ("IMMEDIATE", "IN_PROGRESS", None, None, "NONE"), ("NEVER", "GRADED", None, None, "NONE"), ("ON_SUBMIT", "SUBMITTED", None, None, "FULL"), ("IMMEDIATE", "VOIDED", None, None, "NONE"), ("ODD", "GRADED", None, None, "NONE")])
def test_visibility(spark, policy, status, due, released, level):
    t = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, v=roster.visibility(F.lit(policy), F.lit(status), t(due), t(released), "2024-01-01 00:00:00"))["v"] == level


def test_folded_names(spark):
    assert tuple(one(spark, a=roster.folded_name(F.lit("國立 臺灣大學")), b=roster.folded_name(F.lit(" ")))) == ("台灣大學", None)


def test_throttle_and_quiet_hours():
    now = 1_000_000
    assert notify.throttle([now - 10, now - 20, now - 30], now) == now - 30 + 60_000
    assert notify.throttle([now - 60_001] * 5, now) == now
    three = 3 * 3_600_000 - 8 * 3_600_000 + 86_400_000 * 2  # 03:00 where local time is UTC+8
    sent: list[int] = []
    for _ in range(5):
        sent.append(notify.schedule(sent, three, 22 * 60, 7 * 60))
    assert all(not notify.in_quiet_hours((s // 60_000 + 480) % 1440, 22 * 60, 7 * 60) for s in sent)
    assert len({s // 60_000 for s in sent}) > 1
    assert not notify.in_quiet_hours(100, 60, 60)


def test_thin_predictions_have_no_interval(spark):
    rows = [("u", "ENG", "a", "2026-01-01 00:00:00", 10, "OFFICIAL_GSAT")]
    r = spark.createDataFrame(rows, "user_id string, subject_code string, exam_name string, exam_date string, grade int, source string").withColumn("exam_date", F.col("exam_date").cast("timestamp"))
    p = predict.predict(r, "2027-01-20 00:00:00", ["user_id"]).first()
    assert p["records"] == 1 and p["center"] is None


def test_repaired_json_keeps_private_use_characters(spark):
    from gradelake.functions import parsing as P

    cases = [("a\ue001b\ue000", "a\ue001b\ue000"), ("\\d\\\\x", "\\\\d\\\\x"), ("\\frac\\n\\u00e9\\u12", "\\\\frac\\n\\u00e9\\\\u12"), ("\\", "\\\\"), ("", ""), (None, "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert {r.i: r.r for r in df.select("i", P.repair_json("t").alias("r")).collect()} == {i: w for i, (_, w) in enumerate(cases)}
