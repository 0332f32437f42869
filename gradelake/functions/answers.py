"""Answer texts: normal form, exact rationals and three-valued equality; unit forms (Arrow UDFs: no built-in has NFKC or fractions)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .numeric import col

SAME, DIFFERENT, UNSURE = "SAME", "DIFFERENT", "UNSURE"
#: Dashes that stand for a minus, numerals in characters, and marks or words of mathematics that are not evaluated.
MINUS = "‐‑‒–—―−﹘﹣"
NUMERALS = "〇零一二三四五六七八九十百千萬億兩半"
MARKS = "\\\\^√π∘°∞±×÷≈<>≤≥=∑∫∠"
WORDS = ["分之", "根號", "次方", "倍"]

_TO_MINUS = dict.fromkeys(map(ord, MINUS), "-") | {ord("⁄"): "/", ord("、"): ","}
_LATEX = [(re.compile(r"\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}"), r"\1/\2"), (re.compile(r"\\%"), "%"), (re.compile(r"\\[(),;!\][ ]|[${}]"), "")]
_PLAIN = r"(?:\d+\.?\d*|\.\d+)"
_NUMBER = re.compile(rf"([+-]?{_PLAIN})(?:/([+-]?{_PLAIN}))?(\D*)", re.ASCII)
_GROUPED = re.compile(r"[+-]?\d{1,3}(,\d{3})+(\.\d+)?", re.ASCII)
_MAY_BE_NUMBER = re.compile(f"[0-9{NUMERALS}{MARKS}]|" + "|".join(WORDS))


def normal_text(text: str | None) -> str:
    """NFKC, one kind of minus and fraction bar, no white space, commas for enumeration marks, no final full stop."""
    t = unicodedata.normalize("NFKC", text or "").translate(_TO_MINUS)
    return re.sub(r"[\s\ufeff]+", "", t).rstrip("。")


def strip_math(text: str) -> str:
    """Plain ``\\frac{a}{b}`` (also dfrac, tfrac) to a/b, without dollars, spacing commands and braces."""
    for pattern, to in _LATEX:
        text = pattern.sub(to, text)
    return text


def rational(text: str | None) -> tuple[Fraction, str] | None:
    """(exact number, unit) of a whole text that is one number and what follows it, else None.  A unit holds no digit and is never converted."""
    t = normal_text(strip_math(normal_text(text)))
    if _GROUPED.fullmatch(t):
        t = t.replace(",", "")
    m = _NUMBER.fullmatch(t.removesuffix("."))
    if not m:
        return None
    top, bottom = Fraction(m[1]), Fraction(m[2] or 1)
    return (top / bottom, m[3]) if bottom else None


def compare(a: str | None, b: str | None) -> str:
    """Whether two answers are the same; UNSURE wherever a machine might err.

    Equal normal texts are the same, and a blank is different from all else.  Numbers of one unit
    are compared, those of two units are unsure.  A number and a text that may mean one, texts that differ in
    case alone, and texts that hold digits, numerals or mathematics are unsure; other texts are different.
    """
    x, y = normal_text(a), normal_text(b)
    if x == y or not (x and y):
        return SAME if x == y else DIFFERENT
    numbers = [rational(x), rational(y)]
    if all(numbers):
        (p, u), (q, v) = numbers
        return UNSURE if u != v else SAME if p == q else DIFFERENT
    texts = [t for t, n in zip((x, y), numbers, strict=True) if not n]
    doubt = any(map(_MAY_BE_NUMBER.search, texts)) or (len(texts) == 2 and x.lower() == y.lower())
    return UNSURE if doubt else DIFFERENT


def alternatives(text: str | None) -> list[str]:
    """Accepted answers: parts between bars, unless the text is LaTeX or a part is blank; none of a blank text."""
    t = (text or "").strip()
    parts = [p.strip() for p in t.split("|")]
    if "\\" in t or not all(map(normal_text, parts)):
        parts = [t]
    return parts if normal_text(t) else []


def fill_text(got: str | None, want: str | None) -> str:
    """SAME if any accepted answer is; UNSURE without a standard answer or where one may be the same, else DIFFERENT.

    A number that differs from an accepted number is wrong even if another accepted answer cannot be read as a number.
    """
    accepted = alternatives(want)
    if not accepted or not normal_text(got):
        return DIFFERENT if accepted else UNSURE
    seen = {alt: compare(got, alt) for alt in accepted}
    unsure = [alt for alt, v in seen.items() if v == UNSURE]
    if SAME in seen.values() or not unsure:
        return SAME if SAME in seen.values() else DIFFERENT
    settled = DIFFERENT in seen.values() and rational(got) is not None and not any(map(rational, unsure))
    return DIFFERENT if settled else UNSURE


def fill_slot(got: list[str | None] | None, want: list[str | None] | None) -> str:
    """All slots the same: SAME; one different, or all blank: DIFFERENT; else, without a standard answer or with too many slots: UNSURE."""
    g, w = [x or "" for x in (got if got is not None else [])], [x or "" for x in (want if want is not None else [])]
    if len(g) > len(w) or not any(map(normal_text, w)):
        return UNSURE
    if not any(map(normal_text, g)):
        return DIFFERENT
    seen = {compare(a, b) for a, b in zip(g + [""] * (len(w) - len(g)), w, strict=True)}
    return next(v for v in (DIFFERENT, UNSURE, SAME) if v in seen)


@F.pandas_udf(StringType())
def same_text(got: pd.Series, want: pd.Series) -> pd.Series:
    return pd.Series([fill_text(g, w) for g, w in zip(got, want, strict=True)])


@F.pandas_udf(StringType())
def same_slots(got: pd.Series, want: pd.Series) -> pd.Series:
    return pd.Series([fill_slot(g, w) for g, w in zip(got, want, strict=True)])


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(normal_text)


@F.pandas_udf(BooleanType())
def holds_all(text: pd.Series, keywords: pd.Series) -> pd.Series:
    """Whether a text that is not blank holds every keyword, all in normal form; null without keywords."""
    out = []
    for t, words in zip(text.map(normal_text), keywords, strict=True):
        out.append(bool(t) and all(normal_text(k) in t for k in words) if words is not None and len(words) else None)
    return pd.Series(out, dtype=object)


def slot_list(text) -> Column:
    """Slots of a JSON text: an array, an object by its keys in numeric order, or a single value; null entries are blank."""
    t = F.trim(col(text))
    entries = F.map_entries(F.from_json(t, "map<string,string>"))
    number = lambda e: e["key"].try_cast("double")
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(number(e).isNull().alias("named"), number(e).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    slots = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>")).when(F.startswith(t, F.lit("{")), F.transform(ordered, lambda e: e["v"]))
    one = F.array(F.regexp_replace(t, '^"(.*)"$', "$1"))
    out = F.transform(F.coalesce(slots, one), lambda x: F.coalesce(x, F.lit("")))
    return F.when(t.isNull() | (t == "null") | (t == ""), F.array().cast("array<string>")).otherwise(out)


#: Names of units and their symbols.
UNIT_NAMES = {
    "公里": "km", "公尺": "m", "米": "m", "公分": "cm", "厘米": "cm", "公釐": "mm", "毫米": "mm", "微米": "μm", "奈米": "nm",
    "公噸": "t", "公斤": "kg", "千克": "kg", "公克": "g", "克": "g", "毫克": "mg", "微克": "μg",
    "公升": "L", "毫升": "mL", "立方公尺": "m3", "立方公分": "cm3",
    "秒": "s", "毫秒": "ms", "微秒": "μs", "分鐘": "min", "小時": "hr",
    "牛頓": "N", "焦耳": "J", "瓦特": "W", "瓦": "W", "帕": "Pa", "巴斯卡": "Pa", "大氣壓": "atm", "伏特": "V", "安培": "A",
    "歐姆": "Ω", "庫侖": "C", "赫茲": "Hz", "卡": "cal", "大卡": "kcal", "莫耳": "mol", "百萬分點": "ppm",
}
_SAME_SIGN = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻µΩ", "0123456789+-μΩ")
_TIMES = r"[·⋅∙*×・\s]+"
_FACTOR = re.compile(r"(?P<name>[A-Za-zΑ-Ωα-ω°Ω%‰Å一-\u9fff]+)(?:\^?(?P<power>[+-]?\d+))?")


def normal_unit(text: str | None) -> str:
    """A product of symbols and powers in the order of symbols (``kg·m·s^-2``), prefixes as they are.

    What cannot be read is ``?`` and the text, so that it equals nothing but itself; a blank is blank.
    """
    t = " ".join((text or "").split())
    powers: Counter[str] = Counter()
    over = re.sub(r"\\(?:mathrm|text|rm)|[${}()]", "", t).translate(_SAME_SIGN).split("/")
    for sign, side in zip([1, *[-1] * len(over)], over, strict=False):
        for part in filter(None, re.split(_TIMES, side)):
            m = _FACTOR.fullmatch(part)
            name = UNIT_NAMES.get(m["name"], m["name"]) if m else ""
            symbol = name.rstrip("0123456789")
            if not symbol or re.search("[一-\u9fff]", symbol):
                return "?" + t
            powers[symbol] += sign * int(m["power"] or 1) * int(name[len(symbol) :] or 1)
    return "·".join(s if n == 1 else f"{s}^{n}" for s, n in sorted(powers.items()) if n)


def same_unit(a: str | None, b: str | None) -> bool:
    """Whether two units are one; a unit that is not stated contradicts none."""
    x, y = normal_unit(a), normal_unit(b)
    return not (x and y) or x == y


@F.pandas_udf(StringType())
def unit_form(text: pd.Series) -> pd.Series:
    return text.map(normal_unit)
