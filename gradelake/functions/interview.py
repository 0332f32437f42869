"""The form of an interview answer: whether it gives what the question asks for, stands on something concrete, and agrees with itself."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, let

#: What makes an answer concrete, phrases that say nothing, pairs that contradict each other, and what questions want (None: a name).
CONCRETE = {
    "時間": "高[一二三123]|國中|[一二三上下]學期|[0-9０-９]+\\s*(?:年|月|週|天|小時)|那年|那次|去年|暑假|寒假", "數量": "[0-9０-９]+\\s*(?:個|次|人|組|篇|件|題|分|名|%|％)|[一二三四五六七八九十]+\\s*(?:個|次|人|組|篇|件)",
    "具名": "「[^」]{2,}」|『[^』]{2,}』|[A-Za-z]{3,}|社|隊|營|科展|競賽|專題|課程|實驗|比賽",
}
VAGUE = ["學到(?:了)?很多", "收穫(?:良多|滿滿|很多)", "獲益良多", "印象深刻", "很有(?:興趣|熱忱|熱情)", "培養了?(?:團隊合作|溝通能力|解決問題的能力)", "讓我成長(?:很多)?", "受益匪淺", "大開眼界"]
AGAINST = {
    "說沒參加過又說在裡面學到": ("(?:沒有|未曾|不曾)(?:參加|加入)過?(?:任何)?(?:社團|活動|競賽)", "(?:社團|活動|競賽)(?:裡|中|時)"), "說不擅長又說很擅長": (r"(?:不太?|沒有)(?:擅長|拿手|喜歡)([\x{4E00}-\x{9FFF}]{2,4})", "(?:很|非常|相當)(?:擅長|拿手|喜歡)"),
    "說第一次又說做過很多次": ("第一次(?:接觸|做|參加|嘗試)", "很多次|好幾次|經常|每次都"), "說沒經驗又舉了經驗": ("(?:完全)?(?:沒有|無)(?:相關)?經驗", "我曾|我有|我做過|我參加過"),
}
WANTED = {
    "一個理由": ("為什麼|為何|什麼原因|怎麼會", "因為|原因|理由|所以|之所以|是因|由於|考量|著眼|出發點"), "一段過程": ("怎麼(?:做|處理|辦|過|克服|準備|回應|面對)|如何|怎樣", "先|然後|接著|後來|最後|於是|我把|改成|試著|做法|步驟|方式|一開始"),
    "一個具體指名的東西": ("哪一|哪個|哪些|哪門|是哪", None), "一個明確的有或沒有": ("有沒有|是不是|會不會|能不能|做得到嗎|撐得住", "有|沒有|不曾|曾經|是|不是|會|不會|可以|不行|做得到|做不到"),
}
SHORT, LONG = 80, 600


def letters(text) -> Column:
    """How many characters of a text are neither white space nor punctuation nor symbols."""
    return F.length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\s\x{3000}\p{P}\p{S}]+", ""))


def _named(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def structure_feedback(answer, question, focus) -> Column:
    """{letters, found, vague, unmet, contradictions, addressed, concrete, ask}: ``ask`` names what to ask the student next, in order.

    ``unmet`` are the forms that the question asks for and the answer lacks; ``focus`` (array) is what only the student can judge.  At most two unmet forms are asked, each as FORM:<form>; then
    FOCUS, WHEN, HOW_MANY, VAGUE, CONTRADICTION, TOO_SHORT and TOO_LONG.  A null answer is empty; a null question asks for no form.
    """
    given = {"t": F.coalesce(col(answer), F.lit("")), "q": F.coalesce(col(question), F.lit("")), "focus": F.size(F.coalesce(col(focus), F.array().cast("array<string>"))) > 0}
    return let(F.struct(*[c.alias(name) for name, c in given.items()]), _structure)


def _openings(pattern: str) -> list[str]:
    """Plain texts, one of which every match of a pattern begins with; none if that is not known."""
    if m := re.match(r"\(\?:([^()\[\]\\?*+{}.^$]+)\)(?![?*{])", pattern):
        return m[1].split("|")
    plain = re.match(r"[^()\[\]\\?*+{}.^$|]*", pattern)[0]
    plain = plain[:-1] if pattern[len(plain) :][:1] in ("?", "*", "{") else plain
    return [plain] if plain else []


def says(text: Column, pattern: str) -> Column:
    """As ``rlike``: alternatives that are plain texts are searched as such, others only where a text that they begin with is found."""
    ways, depth = [""], 0
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            ways.append("")
        else:
            ways[-1] += c
    found = []
    for way in ways:
        first = [F.contains(text, F.lit(o)) for o in _openings(way)]
        at = functools.reduce(Column.__or__, first) if first else None
        found.append(at if [way] == _openings(way) else text.rlike(way) if at is None else at & text.rlike(way))
    return functools.reduce(Column.__or__, found)


def _structure(given: Column) -> Column:
    """The answer of ``structure_feedback``, each text and list worked out once."""
    t, q = given["t"], given["q"]
    found = _named({name: says(t, p) for name, p in CONCRETE.items()})
    vague = sum((says(t, p).cast("int") for p in VAGUE), F.lit(0))
    against = _named({name: says(t, a) & says(t, b) for name, (a, b) in AGAINST.items()})

    def unmet(x: Column) -> Column:
        return _named({want: q.rlike(asks) & ~(says(t, gives) if gives else F.array_contains(x["found"], "具名")) for want, (asks, gives) in WANTED.items()})

    def whole(x: Column, unmet: Column) -> Column:
        n, found, vague, against = (x[name] for name in ("letters", "found", "vague", "contradictions"))
        more = {"FOCUS": given["focus"], "WHEN": ~F.array_contains(found, "時間"), "HOW_MANY": ~F.array_contains(found, "數量"), "VAGUE": vague > 0, "CONTRADICTION": F.size(against) > 0, "TOO_SHORT": n < SHORT, "TOO_LONG": n > LONG}
        ask = F.concat(F.transform(F.slice(unmet, 1, 2), lambda w: F.concat(F.lit("FORM:"), w)), _named(more))
        return F.struct(n.alias("letters"), found.alias("found"), vague.alias("vague"), unmet.alias("unmet"), against.alias("contradictions"), ((n > 0) & (F.size(unmet) == 0)).alias("addressed"), (F.size(found) >= 2).alias("concrete"), ask.alias("ask"))

    first = F.struct(letters(t).alias("letters"), found.alias("found"), vague.alias("vague"), against.alias("contradictions"))
    return let(first, lambda x: let(unmet(x), lambda u: whole(x, u)))
