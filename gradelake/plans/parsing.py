"""Registered queries on parsing rules: each row of a table with a stated text, against the stated result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import interview as I
from ..functions import parsing as P
from ..functions.numeric import let
from ..sources import tables as T
from .grading import _stated

_JOIN = lambda a: F.array_join(a, "|", "~")
#: Stated texts and what they come to.
UNWRAP = [("各題答對者，得5\n \n分", "各題答對者，得5分"), ("one\ntwo  three\n", "one two three"), ("中文\nEnglish\n中文", "中文English中文"), ("a\r\nb\n\n　c　　d ", "a b c d"), ("", ""), (None, ""), ("  \n ", "")]
INLINE = [("則 m1＝　1　，m2＝　－4　。", "1|－4"), ("則 m1＝　　，m2＝　　。", ""), ("面積為　12 平方公分　", "12 平方公分"), ("一般　間隔　文字", ""), ("故 x＝　，　", ""), (None, "")]
PROVENANCE = [
    ("下列何者正確？ [112學測] 答對率 95%", "112學測/0.95/下列何者正確？"), ("面積約多少？（110 指考）", "110指考/~/面積約多少？"), ("自108學測起，社會科加考混合題型", "~/~/自108學測起，社會科加考混合題型"), ("全班答對率 43%，共 40 人", "~/~/全班答對率 43%，共 40 人"),
    ("甲乙丙 答對率：43％｜111分科｜", "111分科/0.43/甲乙丙"), ("題目 答對率 430%", "~/~/題目 答對率 430%"), (None, "~/~/"),
]
SIEVE = [("國文+英文+數學A", "CHINESE|ENGLISH|MATH_A"), ("國英自總級分", "CHINESE|ENGLISH|SCIENCE"), ("社會", "SOCIAL"), ("數學", ""), ("國文、國文", ""), ("數B與自然兩科之和", "MATH_B|SCIENCE"), ("體育", ""), ("", ""), (None, "")]
QUALIFY = [("國文前標、英文均標", "CHINESE:前標:~|ENGLISH:均標:~"), ("數學A 12級分；自然(底標)", "MATH_A:~:12|SCIENCE:底標:~"), ("數學頂標", ""), ("在校百分比20%", ""), ("社會 16 級分", "SOCIAL:~:~"), ("英語文", ""), (None, "")]
BIRTH = [("95/3/7", "2006-03-07"), ("2006-12-31", "2006-12-31"), ("095.2.30", "~"), ("2008.2.29", "2008-02-29"), ("１／２", "~"), ("", "~"), (None, "~"), ("2007/13/1", "~")]
CONSENT = [("是", "PAPER"), (" 現場簽署 ", "IN_PERSON"), ("線上", "ONLINE"), ("N", "NONE"), ("", "NONE"), (None, "NONE"), ("也許", "~"), ("Paper", "PAPER")]
JSON = [
    (r'{"a": "\frac{1}{2}"}', r"\frac{1}{2}"), (r'{"a": "x\dy"}', r"x\dy"), (r'{"a": "q\"t\\n"}', r'q"t\n'), (r'{"a": "A\u12"}', r"A\u12"), (r'{"a": "1\n2"}', "1\n2"), (r'{"a": "\beta\b."}', "\\beta\b."), ('{"a": ', "~"), (None, "~"), (r'{"a": "\\\\d"}', r"\\d"),
]
CLAIMS = [("我參加「吉他社」和『數學之美』", "數學之美"), ("我在資訊研究社擔任社長", "研究社擔任社|資訊研究社"), ("參加全國科展競賽", "加全國科展競賽|參加全國科展"), ("一次比賽", ""), (None, "")]
CORPUS = "高一參加吉他社，並到全國 科展 競賽"
REPLIES = [
    ("所以答案是 24，對嗎？", "24", "12 加 12 是多少", "ANSWER_PHRASE|BARE_ANSWER"), ("你先想想 12 是怎麼來的？", "24", "12 加 12 是多少", ""), ("一共 24 個步驟，先看哪一個？", "24", "x", ""), ("先看題目。", "24", "x", "NO_QUESTION"), ("A？B？C？", "24", "x", "MULTI_QUESTION"),
    ("The answer is which one?", "WHICH ONE", "", "ANSWER_PHRASE|BARE_ANSWER"), ("寫成 1/24 可以嗎？", "24", "x", ""), ("答案是 7 嗎？", "7", "有 7 個人", ""), (None, "24", "", "NO_QUESTION"),
]
ADVICE = [
    ("你的錄取機率大約 80%", [80.0], 1, "ODDS_PREDICTION|NO_UNCERTAINTY"), ("我無法估算機率，去年最後一名是 12%", [12.0], 1, ""), ("這個系你一定會上", [], 0, "CERTAINTY"), ("不保證錄取，僅供參考", [], 0, ""), ("去年門檻是 35%，僅供參考", [12.0], 1, "UNSOURCED_NUMBER"),
    ("平均是 50 級分", [50.0], 1, "EXTREME_AS_AVERAGE"), ("近三年都在上升", [], 2, "FAKE_YEAR_SPAN"), ("歷年變動很大", [], 2, ""), ("大概有八成", [], 0, "ODDS_IN_WORDS"), (None, [], 0, ""),
]


NUMBERS = [
    ("答案是二十四", "答案是24"), ("三角函數一起看", "三角函數一起看"), ("第三個選項有十二項", "第3個選項有12項"), ("the answer is twenty-four", "the answer is 24"), ("which one of the twelve", "which one of the 12"), ("one hundred twenty steps", "120 steps"), ("The total is nine", "The total is 9"), (None, "~"),
]


#: Parts of entry texts with what each comes to: a rule, left over, of two meanings, or nothing.
QUALIFY_PARTS = [
    ("國文前標", "R=CHINESE:前標:~"), ("數學A 均標(10)", "R=MATH_A:均標:10"), ("數學頂標", "A=數學頂標"), ("在校成績前 20%", ""), ("社會", "U=社會"), ("底標", "U=底標"), ("英文 78 分", "R=ENGLISH:~:~"), ("面試優先", ""), ("自然 12 級分", "R=SCIENCE:~:12"), ("數 9 級分", "A=數 9 級分"),
]


def qualify_parts(s, d):
    """Orders' entry texts of two parts: the rules, what is left over and what has two meanings."""
    k = F.col("o_orderkey")
    part = lambda i: F.element_at(F.array(*[F.lit(t) for t, _ in QUALIFY_PARTS]), (F.floor(k / (1 if i == 0 else 7)) % len(QUALIFY_PARTS) + 1).cast("int"))

    def said(r):
        return F.concat(F.transform(r["rules"], lambda x: F.concat(F.lit("R="), F.concat_ws(":", x["subject"], _none(x["standard"]), _none(x["grade"])))), F.transform(r["unparsed"], lambda x: F.concat(F.lit("U="), x)), F.transform(r["ambiguous"], lambda x: F.concat(F.lit("A="), x)))

    report = P.qualify_report(F.concat(part(0), F.lit("、"), part(1)))
    return T.scan(s, d, "orders").select("o_orderkey", F.array_join(F.array_sort(let(report, said)), "|").alias("result"))


def sieve_ambiguity(s, d):
    """Sums of two names: whether a bare 數 stops the reading."""
    names = F.array(*[F.lit(x) for x in ("國文", "數", "數A", "自然", "體育")])
    k = F.col("o_orderkey")
    t = F.concat(F.element_at(names, (k % 5 + 1).cast("int")), F.lit("+"), F.element_at(names, (F.floor(k / 5) % 5 + 1).cast("int")))
    return T.scan(s, d, "orders").select("o_orderkey", P.sieve_ambiguous(t).alias("ambiguous"))


#: Advice and whether it cites a source.
CITED = [("依簡章，這個系看重英文", True), ("官方統計資料顯示門檻不高", True), ("簡章可以再看一次", False), ("大考中心的公告寫著日期", True), ("想一想你要什麼", False)]


def advice_sources(s, d):
    """Orders as advice: a cited source counts against it where no official document is at hand."""
    o = T.scan(s, d, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(t) for t, _ in CITED]), (F.col("o_orderkey") % len(CITED) + 1).cast("int")).alias("t"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3 == 1).alias("official"))
    return o.select("o_orderkey", F.array_join(P.advice_issues("t", F.array().cast("array<double>"), F.lit(3), "official"), "|").alias("result"))


#: Parts of interview answers, each said by one bit of the order's number, and questions.
ANSWER_PARTS, ASKED = ["去年", "3次", "吉他社", "獲益良多", "因為", "第一次接觸經常"], ["為什麼選這裡", "哪一件事", "說說自己", None]


def interview_structure(s, d):
    """Orders as interview answers made of parts and a filler: what is found, missing and asked next."""
    k = F.col("o_orderkey")
    parts = F.array_compact(F.array(*[F.when(F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1, p) for i, p in enumerate(ANSWER_PARTS)]))
    answer = F.array_join(F.concat(parts, F.array(F.repeat(F.lit("嗯"), (F.col("o_custkey") % 8 * 90).cast("int")))), "，")
    asked = F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("o_custkey") % 4 + 1).cast("int"))
    r = I.structure_feedback(answer, asked, F.when(k % 3 == 0, F.array(F.lit("動機"))))
    o = T.scan(s, d, "orders").select("o_orderkey", r.alias("r"))
    return o.select("o_orderkey", F.col("r.letters").cast("long").alias("letters"), "r.vague", "r.addressed", "r.concrete", F.array_join("r.ask", ",").alias("ask"))


def _rows(s, d, cases, names=("t",)):
    """Every order with one of the stated inputs."""
    kinds = ", ".join(f"{n}: {'array<double>' if n == 'numbers' else 'int' if n == 'years' else 'string'}" for n in names)
    literal = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<double>") if isinstance(v, list) else F.lit(v)
    inputs = F.array(*[F.struct(*[literal(v).alias(n) for n, v in zip(names, c, strict=False)]).cast(f"struct<{kinds}>") for c in cases])
    return T.scan(s, d, "orders").select("o_orderkey", F.element_at(inputs, (F.col("o_orderkey") % len(cases) + 1).cast("int")).alias("c")).select("o_orderkey", "c.*")


def _none(x):
    return F.coalesce(x.cast("string"), F.lit("~"))


def _provenance(t):
    exam, rate, text = P.provenance(t)
    return F.concat_ws("/", _none(exam), _none(rate), text)


def _qualify(t):
    return F.array_join(F.transform(P.qualify_rules(t), lambda r: F.concat_ws(":", r["subject"], _none(r["standard"]), _none(r["grade"]))), "|")


RULES = {
    "text_unwrap": (UNWRAP, ("t",), lambda: P.unwrap("t")),
    "inline_answers": (INLINE, ("t",), lambda: _JOIN(P.inline_answers("t"))),
    "provenance_badges": (PROVENANCE, ("t",), lambda: _provenance("t")),
    "sieve_subjects": (SIEVE, ("t",), lambda: _JOIN(P.sieve_subjects("t"))),
    "qualify_rules": (QUALIFY, ("t",), lambda: _qualify("t")),
    "parse_birth": (BIRTH, ("t",), lambda: _none(P.birth("t"))),
    "parse_consent": (CONSENT, ("t",), lambda: _none(P.consent("t"))),
    "tolerant_json": (JSON, ("t",), lambda: _none(F.try_variant_get(P.tolerant_json("t"), "$.a", "string"))),
    "claim_check": (CLAIMS, ("t",), lambda: _JOIN(P.unmatched_claims("t", F.lit(CORPUS)))),
    "number_words": (NUMBERS, ("t",), lambda: _none(P.plain_numbers("t"))),
    "tutor_reply_issues": (REPLIES, ("t", "answer", "stem"), lambda: _JOIN(P.reply_issues("t", "answer", "stem"))),
    "advice_issues": (ADVICE, ("t", "numbers", "years"), lambda: _JOIN(P.advice_issues("t", "numbers", "years"))),
}


def _query(cases, names, rule):
    return lambda s, d: _rows(s, d, cases, names).select("o_orderkey", rule().alias("result"))


QUERIES = {name: _query(*spec) for name, spec in RULES.items()}
ORACLES = {name: _stated(cases, "orders", "o_orderkey", "result", "o_orderkey") for name, (cases, _, _) in RULES.items()}
QUERIES |= {"qualify_parts": qualify_parts, "sieve_ambiguity": sieve_ambiguity}
_PARTS = "([" + ", ".join(f"'{r}'" for _, r in QUALIFY_PARTS) + "])[CAST({} AS BIGINT) % " + str(len(QUALIFY_PARTS)) + " + 1]"
ORACLES["qualify_parts"] = f"SELECT o_orderkey, array_to_string(list_sort(list_filter([{_PARTS.format('o_orderkey')}, {_PARTS.format('o_orderkey // 7')}], lambda x: x <> '')), '|') AS result FROM orders"
ORACLES["sieve_ambiguity"] = "SELECT o_orderkey, o_orderkey % 5 = 1 OR o_orderkey % 5 <> 4 AND o_orderkey // 5 % 5 = 1 AS ambiguous FROM orders"
QUERIES["interview_structure"] = interview_structure
_BITS = ", ".join(f"(o_orderkey >> {i}) & 1 = 1 AS b{i}" for i in range(len(ANSWER_PARTS)))
_LENGTH = " + ".join(f"CASE WHEN b{i} THEN {len(p)} ELSE 0 END" for i, p in enumerate(ANSWER_PARTS))
ORACLES["interview_structure"] = f"""WITH b AS (SELECT o_orderkey, o_custkey % 4 AS q, o_custkey % 8 * 90 AS filler, o_orderkey % 3 = 0 AS focus, {_BITS} FROM orders),
x AS (SELECT *, CAST({_LENGTH} + filler AS BIGINT) AS letters, b1 OR b5 AS many, CASE WHEN q = 0 AND NOT b4 THEN '一個理由' WHEN q = 1 AND NOT b2 THEN '一個具體指名的東西' END AS unmet FROM b)
SELECT o_orderkey, letters, CAST(b3 AS INT) AS vague, letters > 0 AND unmet IS NULL AS addressed, CAST(b0 AS INT) + CAST(many AS INT) + CAST(b2 AS INT) >= 2 AS concrete,
  array_to_string(list_filter(['FORM:' || unmet, CASE WHEN focus THEN 'FOCUS' END, CASE WHEN NOT b0 THEN 'WHEN' END, CASE WHEN NOT many THEN 'HOW_MANY' END, CASE WHEN b3 THEN 'VAGUE' END, CASE WHEN b5 THEN 'CONTRADICTION' END, CASE WHEN letters < 80 THEN 'TOO_SHORT' END, CASE WHEN letters > 600 THEN 'TOO_LONG' END], lambda v: v IS NOT NULL), ',') AS ask FROM x"""
QUERIES["advice_sources"] = advice_sources
ORACLES["advice_sources"] = f"SELECT o_orderkey, CASE WHEN ([{', '.join(str(x).lower() for _, x in CITED)}])[o_orderkey % {len(CITED)} + 1] AND o_custkey % 3 <> 1 THEN 'FAKE_SOURCE' ELSE '' END AS result FROM orders"
