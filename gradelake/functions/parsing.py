"""Texts from scans, forms and models taken apart: lines, badges, filled blanks, subjects, rules, dates, JSON (column expressions; number words in an Arrow UDF)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numeric import col, let

_CJK = r"\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
_ENDS = r"^[\s\x{3000}]+|[\s\x{3000}]+$"


def strip(text) -> Column:
    """Without white space of any width at both ends."""
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), _ENDS, "")


def unwrap(text) -> Column:
    """Lines joined into one: nothing is put between where a Chinese character stands on either side, else a blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\R"), strip), lambda x: x != "")
    whole = F.regexp_replace(F.array_join(lines, "\n"), f"(?<=[{_CJK}])\n|\n(?=[{_CJK}])", "")
    return F.trim(F.regexp_replace(F.replace(whole, F.lit("\n"), F.lit(" ")), r"[ \t\x{3000}]{2,}", " "))


#: What stands before a filled blank.
_BEFORE = "＝=為是：:⇒得"


def inline_answers(text) -> Column:
    """What is filled in between pairs of full-width blanks after a place where an answer belongs."""
    parts = F.split(F.coalesce(col(text), F.lit("")), "\u3000")
    filled = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & F.get(parts, i - 1).rlike(rf"[{_BEFORE}][\s\x{{3000}}]*$"), strip(x)))
    return F.filter(filled, lambda x: x.isNotNull() & (x != "") & ~x.rlike(r"^[，、。：；．,.:;]+$"))


#: Names of exams, and what may stand between badges.
_RATE = r"答對率\s*[：:]?\s*(?:100|0?[0-9]{1,2})\s*[%％]"
_EXAM = r"1[0-2][0-9]\s*(?:學測|指考|分科|統測|會考)"
_FILLER = r"[\s\[\]()（）【】｜|,，、／/·．.:：-]*"


def provenance(text) -> tuple[Column, Column, Column]:
    """(exam, share of right answers, text without them) from the badges at the very end of a text; badges elsewhere are content."""
    t = F.coalesce(col(text), F.lit(""))
    tail = F.regexp_extract(t, rf"((?:(?:{_RATE}|{_EXAM}){_FILLER})+)$", 1)
    exam = F.regexp_replace(F.regexp_extract(tail, rf"(?s).*({_EXAM})", 1), r"\s+", "")
    rate = F.regexp_extract(tail, rf"(?s).*答對率\s*[：:]?\s*(100|0?[0-9]{{1,2}})\s*[%％]", 1)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
    # a badge leaves its bracket behind: an opening one at the end, or a pair around nothing; gaps that this makes are one blank
    clean = strip(F.regexp_replace(F.regexp_replace(head, r"[\[(（【]\s*(?:[\])）】]|$)", ""), r"[ \t\x{3000}]{2,}", " "))
    return F.nullif(exam, F.lit("")), (F.nullif(rate, F.lit("")).cast("int") / 100.0), F.when(tail == "", t).otherwise(clean)


#: Subjects and what they are called, longer names first.
SUBJECTS = {
    "MATH_A": ["數學A", "數學a", "數學Ａ", "數A", "數a", "數Ａ"], "MATH_B": ["數學B", "數學b", "數學Ｂ", "數B", "數b", "數Ｂ"], "CHINESE": ["國語文", "國文", "國"],
    "ENGLISH": ["英語文", "英文", "英語", "英"], "SCIENCE": ["自然", "自"], "SOCIAL": ["社會", "社"],
}
_NAMES = {name: code for code, names in SUBJECTS.items() for name in names}
_ANY = "|".join(sorted(_NAMES, key=lambda n: -len(n)))
_NOISE = r"總?級分|總分|合計|加總|之和|的和|[一二三四五六兩]科|[1-6]科|以上|門檻|標準|級|分|\s|＋|\+|、|,|，|及|和|與|的"
#: The five standards.
STANDARDS = "頂前均後底"


def _code(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in _NAMES.items() for x in p])[name]


def sieve_subjects(text) -> Column:
    """The subjects that a sieve adds up; empty where any part is no subject (a bare 數 may be either) or one comes twice."""
    rest = F.regexp_replace(F.coalesce(col(text), F.lit("")), _NOISE, "")
    names = F.regexp_extract_all(rest, F.lit(f"({_ANY})"), F.lit(1))
    codes = F.transform(names, _code)
    whole = (F.array_join(names, "") == rest) & (F.size(F.array_distinct(codes)) == F.size(codes))
    return F.when(whole, codes).otherwise(F.array().cast("array<string>"))


def sieve_ambiguous(text) -> Column:
    """Whether a sieve names mathematics without saying which where its reading stops: then it has no subjects, but for another reason than an unknown word."""
    rest = F.regexp_replace(F.coalesce(col(text), F.lit("")), _NOISE, "")
    return F.startswith(F.regexp_replace(rest, f"^(?:{_ANY})*", ""), F.lit("數"))


def qualify_report(text) -> Column:
    """What an entry text says, and what of it could not be used: {rules: [{subject, standard, grade}], unparsed, ambiguous}.

    A part is what stands between commas, semicolons, slashes or wide gaps.  School percentages are another matter and left out.  A part with a subject and a
    standard or a number is a rule (a number that is no grade of 0 to 15 is dropped); 數 without A or B beside a standard or number is ambiguous; a subject alone, or
    a standard without a subject, is unparsed; any other part says nothing.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"[、,，;；/]|\s{2,}"), strip), lambda x: x != "")
    standard = lambda x: F.nullif(F.regexp_extract(x, f"[{STANDARDS}]標", 0), F.lit(""))
    number = lambda x: F.nullif(F.regexp_extract(x, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")

    def judge(x: Column, said: Column) -> Column:
        code, standard, number = said["code"], said["standard"], said["number"]
        says = standard.isNotNull() | number.isNotNull()
        grade = F.when((number == F.floor(number)) & number.between(0, 15), number.cast("int"))
        of = F.when(x.rlike("在校|百分|%|％") & standard.isNull(), "SCHOOL").when(code.isNotNull() & says, "RULE").when(code.isNotNull(), "UNPARSED")
        of = of.when(F.contains(x, F.lit("數")) & says, "AMBIGUOUS").when(standard.isNotNull(), "UNPARSED").otherwise("NOTHING")
        return F.struct(of.alias("of"), x.alias("raw"), code.alias("subject"), standard.alias("standard"), grade.alias("grade"))

    def read(x: Column) -> Column:
        names = F.transform(F.regexp_extract_all(x, F.lit(f"({_ANY})"), F.lit(1)), lambda n: F.struct(F.length(n).alias("n"), n.alias("name")))
        said = F.struct(_code(F.array_max(names)["name"]).alias("code"), standard(x).alias("standard"), number(x).alias("number"))
        return let(said, lambda y: judge(x, y))

    def sort(every: Column) -> Column:
        raw = lambda kind: F.transform(F.filter(every, lambda r: r["of"] == kind), lambda r: r["raw"])
        rules = F.transform(F.filter(every, lambda r: r["of"] == "RULE"), lambda r: F.struct(r["subject"].alias("subject"), r["standard"].alias("standard"), r["grade"].alias("grade")))
        return F.struct(rules.alias("rules"), raw("UNPARSED").alias("unparsed"), raw("AMBIGUOUS").alias("ambiguous"))

    return let(F.transform(parts, read), sort)


def qualify_rules(text) -> Column:
    """The rules of ``qualify_report`` alone."""
    return qualify_report(text)["rules"]


def birth(text) -> Column:
    """A date from year/month/day with any of / - . between; years below 200 are ROC years; null for what is no day."""
    t = F.regexp_replace(strip(text), "[／.-]", "/")
    part = lambda i: F.nullif(F.regexp_extract(t, r"^([0-9]{2,4})/([0-9]{1,2})/([0-9]{1,2})$", i), F.lit("")).cast("int")
    year = part(1) + F.when(part(1) < 200, 1911).otherwise(0)
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, part(2), part(3)), F.lit("yyyy-MM-dd")))


#: Words for no, yes and the ways that consent was given.
NO, YES = ["否", "無", "未取得", "沒有", "n", "no", "false", "0", "-", "—"], ["是", "有", "已取得", "已同意", "同意", "y", "yes", "true", "1", "v"]
WAYS = {"現場": "IN_PERSON", "現場簽署": "IN_PERSON", "現場簽名": "IN_PERSON", "臨櫃": "IN_PERSON", "in_person": "IN_PERSON", "紙本": "PAPER", "紙本回條": "PAPER", "回條": "PAPER", "paper": "PAPER", "線上": "ONLINE", "線上同意": "ONLINE", "online": "ONLINE"}


def consent(text) -> Column:
    """NONE, a way (a plain yes is PAPER), or null for a word that is not known."""
    t = F.lower(strip(text))
    way = F.create_map(*[F.lit(x) for p in WAYS.items() for x in p])[t]
    return F.when((t == "") | t.isin(*NO), "NONE").when(way.isNotNull(), way).when(t.isin(*YES), "PAPER")


def repair_json(text) -> Column:
    """JSON of a model with stray backslashes made literal: an escape stays if it is one, and \\f or \\b before a letter is a LaTeX command.

    Each backslash is looked at once, with what follows it: a pair or an escape is passed over whole, any other is doubled.
    """
    escape = r'\\(?:\\|u[0-9a-fA-F]{4}|[bf](?![A-Za-z])|["/nrt])'
    parts = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(rf"(?s){escape}|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "\\", "\\\\").otherwise(p)), "")


def tolerant_json(text) -> Column:
    """The value of a repaired JSON text, of the text itself where that fails, else null."""
    return F.coalesce(F.try_parse_json(repair_json(text)), F.try_parse_json(col(text)))


#: Endings of names of clubs, teams, places and contests, and characters that end a name.
_SUFFIX = "社|隊|營|團|中心|實驗室|科展|競賽|比賽|檢定|證照|專題|工作坊"
_STOP = "的了是在和與及我你他她它們這那有就也都很過到從對把被給讓做去來會要還又再並而但最後然個位次件"


def claims(text) -> Column:
    """Names that a text claims, of three characters or more: what is quoted, and what ends like a club or contest."""
    t = F.coalesce(col(text), F.lit(""))
    quoted = F.regexp_extract_all(t, F.lit("[「『]([^」』]{2,12})[」』]"), F.lit(1))
    at = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
    named = F.transform(at, lambda i: F.regexp_extract(F.substring(t, F.greatest(i - 5, F.lit(1)), F.least(i - 1, F.lit(5))), rf"([\x{{4E00}}-\x{{9FFF}}&&[^{_STOP}]]+)$", 1))
    ends = F.transform(at, lambda i: F.regexp_extract(F.substring(t, i, F.lit(3)), f"^({_SUFFIX})", 1))
    tokens = F.zip_with(named, ends, lambda n, e: F.when((n != "") & (e != ""), F.concat(n, e)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(quoted, F.array_compact(tokens)), lambda x: F.length(x) >= 3)))


def unmatched_claims(text, corpus) -> Column:
    """Claims that the writer's own texts do not hold, compared without white space, punctuation and symbols."""
    bare = lambda x: F.regexp_replace(x, r"[\s\p{P}\p{S}]+", "")
    own = bare(F.coalesce(col(corpus), F.lit("")))
    return F.filter(claims(text), lambda c: ~F.contains(own, bare(c)))


#: Phrases that announce an answer.
CUES = ["答案是", "答案為", "答案就是", "答案:", "正確答案", "標準答案", "正解", "故選", "所以選", "應該選", "所以是", "就是", "等於", "the answer", "answer is", "answer:", "correct answer"]
MOST_REPLY = 350


def reply_issues(reply, answer, stem) -> Column:
    """Codes of a tutor's reply: the answer announced or bare, no or many questions, too long.

    The answer counts where it is not in the question itself; a cue reaches 24 characters back and 60 ahead.  A
    number stands alone only if no digit, point or slash continues it, and not before a counting word.
    """
    norm = lambda x: F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(col(x), F.lit("")), "０１２３４５６７８９：＝", "0123456789:=")), r"[ \t]+", " "))
    t, a = norm(reply), norm(answer)
    literal = F.concat(F.lit(r"\Q"), F.replace(a, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    alone = F.concat(F.lit(r"(?<![\d./])"), literal, F.lit(r"(?![./]?\d)(?!\s*(?:個|題|步|次|種|項|steps?|options?|questions?))"))
    secret = (a != "") & ~F.contains(norm(stem), a)
    cue = f"(?:{'|'.join(CUES)})"
    said = F.coalesce(F.regexp_like(t, F.concat(F.lit(f"(?s){cue}.{{0,60}}?"), alone)) | F.regexp_like(t, F.concat(F.lit("(?s)"), alone, F.lit(f".{{0,24}}?{cue}"))), F.lit(False))
    bare = F.coalesce(F.regexp_like(t, alone), F.lit(False)) & (F.length(a) >= 2)
    asked = F.regexp_count(t, F.lit("[?？]"))
    rules = {
        "ANSWER_PHRASE": secret & said, "BARE_ANSWER": secret & bare, "NO_QUESTION": asked == 0, "MULTI_QUESTION": asked >= 3, "TOO_LONG": F.length(F.regexp_replace(t, r"\s+", "")) > MOST_REPLY,
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))


#: Words of odds, of certainty, of averages, of several years and of doubt.
_ODDS = "機率|機會|可能性|勝算|勝率|成功率|錄取率|通過率|probability|chance|odds|likelihood"
_SURE = "一定(?:上|會上|能上|考得上|錄取|過關|通過|沒問題)|穩(?:上|過)|保證|沒問題|篤定|鐵定|勝券在握|絕對(?:上|會上|沒問題|可以)|輕鬆(?:上|過|錄取|通過)"
_MEAN = "平均|均值|中位數|average|median"
_THREE, _TWO = "近三年|近 ?3 ?年|這三年|過去三年|三年來|前三年|近三屆|三年的資料|三年的趨勢", "近兩年|近 ?2 ?年|這兩年|過去兩年|兩年來|歷年|逐年|每一年都|年年"
_DOUBT = "極值|只有一個|唯一一個|波動|樣本|不確定|最後一名|參考|不保證|變動|趨勢"
_NOT = "(?<![不沒無非別未][^。，,]{0,7})"
_CITED = "(?:依|根據|按照|依照|依據)(?:官方|簡章|委員會|大考中心|教育部|招聯會|榜單)|官方(?:公布|統計)(?:的)?(?:資料|數字|標準)?(?:顯示|指出|寫著|說明|說)|簡章(?:上|裡)?(?:寫|明訂|規定|載明)(?:著|明)?|(?:大考中心|委員會|招聯會)(?:的)?(?:統計|資料|公告)(?:顯示|指出|寫著)"
MOST_ADVICE = 700


def advice_issues(advice, numbers, years, official=None) -> Column:
    """Codes of an advice text: odds with numbers, certainty, numbers without a source, extremes as averages, spans of years, length.

    A phrase after a negation within eight characters does not count.  numbers: array<double> that the data give; years: how many years of data there are; official: whether any of it is an official document (without the
    argument, sources are not judged).
    """
    t = F.coalesce(col(advice), F.lit(""))
    said = F.transform(F.regexp_extract_all(t, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(?:%|級分|名|人|分)(?![鐘之])"), F.lit(1)), lambda x: x.cast("double"))
    rules = {
        "ODDS_PREDICTION": t.rlike(rf"(?i){_NOT}(?:{_ODDS})(?!.{{0,9}}(?:無法|不能|不做|不估|不算)).{{0,24}}?[0-9]") | t.rlike(rf"(?i)[0-9][^。]{{0,24}}?{_NOT}(?:{_ODDS})(?!.{{0,9}}(?:無法|不能|不做|不估|不算))"),
        "ODDS_IN_WORDS": t.rlike(rf"{_NOT}(?:[一二三四五六七八九兩幾]成(?![功績本長立為果員熟就分])|十之八九|十拿九穩)"),
        "CERTAINTY": t.rlike(f"{_NOT}(?:{_SURE})"),
        "UNSOURCED_NUMBER": F.exists(said, lambda x: ~F.array_contains(F.coalesce(col(numbers), F.array().cast("array<double>")), x)),
        "EXTREME_AS_AVERAGE": t.rlike(rf"(?i){_NOT}(?:{_MEAN}).{{0,24}}?[0-9]") | t.rlike(rf"(?i)[0-9].{{0,24}}?{_NOT}(?:{_MEAN})"),
        "FAKE_SOURCE": t.rlike(_CITED) & ~F.coalesce(col(official), F.lit(False)) if official is not None else F.lit(False),
        "FAKE_YEAR_SPAN": (t.rlike(_THREE) & (F.coalesce(col(years), F.lit(0)) < 3)) | (t.rlike(_TWO) & (F.coalesce(col(years), F.lit(0)) < 2)),
        "NO_UNCERTAINTY": t.rlike(r"[0-9]\s*%") & ~t.rlike(_DOUBT),
        "TOO_LONG": F.length(F.regexp_replace(t, r"\s+", "")) > MOST_ADVICE,
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))


#: Number words, and what stands before and after a digit that is one.
_HAN = {"零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_SMALL = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 1)}
_TENS = {w: i * 10 for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_AHEAD, _UNITS = "第|選項|答案是|答案為|正解是|正確答案是|選", "個項號題步次"
_ONES = "|".join(w for w, n in _SMALL.items() if n < 10)
_HAN_TENS = re.compile("([一二兩三四五六七八九]?)十([一二兩三四五六七八九]?)")
_HAN_ONE = re.compile(f"({_AHEAD})([{''.join(_HAN)}])|([{''.join(_HAN)}])(?=[{_UNITS}])")
_ENGLISH = re.compile(rf"(?i)\b(?:({'|'.join(_TENS)})(?:[-\s]+({_ONES}))?|({'|'.join(w for w, n in _SMALL.items() if n > 9)}))\b")
_HUNDRED = re.compile(rf"(?i)\b({_ONES}|\d+)\s+hundred(?:\s+(?:and\s+)?(\d+))?\b")
_SAID = re.compile(rf"(?i)\b((?:answers?|ans|result|total|option|number|equals|equal to|choose|pick|select|is|are|was|were|gets?|got|be)\s{{0,3}})({_ONES})\b(?!\s+of\b)")


def _plain(text: str | None) -> str | None:
    if text is None:
        return None
    t = _HAN_TENS.sub(lambda m: str((_HAN[m[1]] if m[1] else 1) * 10 + (_HAN[m[2]] if m[2] else 0)), text)
    t = _HAN_ONE.sub(lambda m: (m[1] or "") + str(_HAN[m[2] or m[3]]), t)
    t = _ENGLISH.sub(lambda m: str(_TENS[m[1].lower()] + _SMALL.get((m[2] or "").lower(), 0) if m[1] else _SMALL[m[3].lower()]), t)
    t = _HUNDRED.sub(lambda m: str((_SMALL.get(m[1].lower()) or int(m[1])) * 100 + int(m[2] or 0)), t)
    return _SAID.sub(lambda m: m[1] + str(_SMALL[m[2].lower()]), t)


@F.pandas_udf(StringType())
def plain_numbers(text: pd.Series) -> pd.Series:
    """Number words as digits: Chinese tens and English teens, tens and hundreds everywhere, single digits only where a number is meant."""
    return text.map(_plain)
