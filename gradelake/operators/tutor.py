"""Whether a tutor's reply gives the answer away, writes for the student, or does not ask.

What must not be said follows from the question: labels and places of right options, numbers that only they hold, or
the answer itself.  One pattern a question finds all of these in a reply in one pass; every rule then looks at the text around what was found.
Replies meet their question by a join, and each question's pattern is made once a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from ..functions.parsing import MOST_REPLY, _plain

#: Phrases that announce an answer, words that confirm, deny or confirm loosely, ways to ask about a guess, counting words.
CUES = ["答案是", "答案為", "答案就是", "答案應該是", "答案:", "答案=", "正確答案", "標準答案", "正解", "正確的是", "對的是", "答對的是", "正確選項", "故選", "所以選", "因此選", "應該選", "要選", "就選", "該選", "選的是", "答:", "∴", "所以是", "因此是", "得到", "就是", "等於", "就在", "="]
CUES += ["the answer", "answer is", "answer:", "answer =", "correct answer", "ans:", "ans =", "the correct one", "the right one", "should choose", "答案"]
AFFIRM = r"(?<![不沒非未])(?:是對的|是正確的|才對|才是對的|才是正解|沒錯|正確無誤|是答案|是正解|符合題意|成立|正確|is correct|is right|is the answer|✓|√)(?![不嗎呢?？])|(?<![不沒非未])(?:對的|正確的)(?=[那這個一])|(?<![不沒非未])對(?=[，,。.！!；;、\s]|$)"
DENY = r"不對|不正確|(?<!沒)錯|不成立|排除|不可能|不符合|不行|不是|✗|×|is wrong|incorrect"
AGREE = r"(?i)(?<![不沒非未])(?:對了|答對|猜對|沒錯|是的|對啊|對呀|對耶|對喔|對唷|就是這樣|就是它|就是那個|就對了|沒有問題|沒問題|很好|太好了|賓果)(?![不嗎呢?？])|(?<![不沒非未])(?:方向|想法|猜的|說的|寫的|講的)(?:那個)?(?:是)?對|(?<!\bnot )\b(?:yes|yeah|yep|exactly|bingo|correct|right|true)\b(?!\s*\?)"
GUESS = r"(?i)對不對|對嗎|對吧|對了嗎|是不是|是嗎|正確嗎|沒錯吧|有沒有錯|可以嗎|可不可以|行不行|我選|我猜|我覺得|我想是|我寫|我填|我答|應該是|會不會是|答案是|要選|選了|選的是|改成|換成|是選|就是|如果.{0,8}選|那.{0,6}呢|is it|isn'?t it|right\s*\?|correct\s*\?|i (?:choose|chose|pick|picked|think|guess|said|selected)|should i (?:choose|pick|select|go)|the answer is|my answer"
UNITS = "個題步次種項行條位人句字遍回分秒度倍年月日"
EN_UNITS = "step minute second hour day week month year option choice time way part question condition number line word letter example sentence paragraph".split()
ENDS = r"=|∴|→|得|共|約|就是|答|等於|equals|is|get|gets|got"
FIRST_PERSON, READER = r"(?i)[我吾]|本人|筆者|敝人|\bI\b|\bmy\b|\bme\b", r"(?i)[你妳您]|\byou\b|\byour\b"
OWN_VOICE = 40
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth"]

_BEFORE, _AFTER = r"(?<!\d)(?<!\d[./])", r"(?!\d)(?![./]\d)"
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:/\d+)?")
_COUNTED = re.compile(rf"-?\d+(?:\.\d+)?\s*(?:[{UNITS}]|(?i:{'|'.join(EN_UNITS)})(?i:s?)\b)")
_HALF = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: " "}
_affirm, _deny, _agree, _guess, _first, _reader = (re.compile(p) for p in (AFFIRM, DENY, AGREE, GUESS, FIRST_PERSON, READER))
_PUNCT = re.compile(r"[\s，。！？、,.!?()（）\[\]:：]")
_LATEX = [
    (re.compile(r"\\therefore"), "∴"), (re.compile(r"\\(?:Rightarrow|rightarrow|implies|to)\b"), "→"), (re.compile(r"\\(?:times|cdot)\b"), "*"), (re.compile(r"\\div\b"), "/"), (re.compile(r"\\(?:left|right)\b|\\[,;!:]|\$"), ""), (re.compile(r"\\\\"), " "),
    (re.compile(r"\\([a-zA-Z]+)"), r"\1"), (re.compile(r"[{}^_]"), ""),
]
_NESTED = [(re.compile(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}"), r"\1/\2"), (re.compile(r"\\(?:boxed|text|textbf|mathrm|mathbf|operatorname|ce|mbox)\s*\{([^{}]*)\}"), r"\1")]


def normal(text: str | None) -> str:
    """One spelling of what reads the same: no LaTeX, half width, number words as digits."""
    t = text or ""
    for _ in range(4):
        for pattern, to in _NESTED:
            t = pattern.sub(to, t)
    for pattern, to in _LATEX:
        t = pattern.sub(to, t)
    return re.sub(r"[ \t\xa0]+", " ", _plain(t.translate(_HALF))).strip()


@dataclass
class Facts:
    """What a question keeps secret.  ``find`` gives everything of it in a text as (kind, item, start, end)."""

    choice: bool
    right: list[str]
    wrong: list[str]
    places: list[int]
    contents: list[str]
    own_contents: list[str]
    values: list[str]

    def __post_init__(self) -> None:
        parts = [("label", x, self._label(x)) for x in self.right] + [("place", str(o), self._place(o)) for o in self.places]
        parts += [("value", v, self._value(v)) for v in self.values] + [("content", c, f"(?i:{re.escape(c)})") for c in self.own_contents]
        self.found = [(kind, item, re.compile(p)) for kind, item, p in parts]
        self.any = re.compile("|".join(f"(?:{p})" for _, _, p in parts)) if parts else None
        self.denied = [re.compile(self._label(x)) for x in self.wrong]

    @staticmethod
    def _label(label: str) -> str:
        x = re.escape(label)
        bare = rf"{_BEFORE}{x}{_AFTER}(?!\s*(?:[{UNITS}元%]|小時|公里|公尺|公分|公克|毫升))" if label.isdigit() else rf"(?<![A-Za-z]){x}(?![A-Za-z])"
        return rf"[(\[]\s*{x}\s*[)\]]|{bare}"

    @staticmethod
    def _place(o: int) -> str:
        word = rf"|(?i:\b{ORDINALS[o - 1]}\b)" if o <= len(ORDINALS) else ""
        return rf"第\s*{o}\s*[個項條]?\s*(?:選項|敘述)?{word}"

    @staticmethod
    def _value(v: str) -> str:
        return f"{_BEFORE}{re.escape(v)}{_AFTER}" if _NUMBER.fullmatch(v) else re.escape(v)

    def find(self, text: str, *kinds: str) -> Iterator[tuple[str, str, int, int]]:
        if self.any and self.any.search(text):
            for kind, item, pattern in self.found:
                if not kinds or kind in kinds:
                    yield from ((kind, item, m.start(), m.end()) for m in pattern.finditer(text))


def answer_facts(stem: str | None, mine: str | None, options: list[dict] | None, texts: list[str] | None) -> Facts:
    """The secrets of a question: options {label, content, correct}, or the accepted texts where there are none."""
    stem_, open_ = normal(stem), set(_NUMBER.findall(normal(stem))) | set(_NUMBER.findall(normal(mine)))
    rows = [(re.sub(r"^[(\[]|[)\]]$", "", normal(o["label"])), normal(o["content"]), bool(o["correct"])) for o in options or []]
    contents, others = [c for _, c, ok in rows if ok], [c for _, c, ok in rows if not ok]
    if rows:
        known = open_.union(*[_NUMBER.findall(c) for c in others])
        values = [n for c in contents for n in _NUMBER.findall(c) if n not in known]
    else:
        values = []
        for t in filter(None, map(normal, texts or [])):
            values += [t] * (len(t) >= 2 and t not in stem_) + [n for n in _NUMBER.findall(t) if n not in open_]
    own = [c for c in contents if len(c) >= 2 and not any(c in w for w in others) and c not in stem_]
    return Facts(bool(rows), [x for x, _, ok in rows if ok and x], [x for x, _, ok in rows if not ok and x], [i + 1 for i, (_, _, ok) in enumerate(rows) if ok], contents, own, list(dict.fromkeys(values)))


def guessed(student: str | None, facts: Facts) -> bool:
    """The student has named the right answer as a guess."""
    t = normal(student)
    spans = list(facts.find(t))
    return bool(spans) and (len(_PUNCT.sub("", t)) <= 6 or any(_guess.search(t[max(0, a - 20) : b + 20]) for _, _, a, b in spans))


def own_voice(text: str) -> int:
    """The longest run of sentences of a paragraph, in letters, in the first person that neither asks nor speaks to the reader."""
    longest = 0
    for paragraph in text.split("\n"):
        run = ""
        for sentence in [*re.findall(r"[^。！？!?；;]+[。！？!?；;]?", paragraph), "?"]:
            if re.search(r"[？?]\s*$", sentence) or _reader.search(sentence):
                if _first.search(run):
                    longest = max(longest, len(re.sub(r"\s", "", run)))
                run = ""
            else:
                run += sentence
    return longest


def reply_codes(reply: str | None, facts: Facts, student: str | None = None, most: int = MOST_REPLY) -> list[tuple[str, str]]:
    """(code, severity) of a reply: LEAK gives the answer away, GHOST writes for the student, STYLE does not lead."""
    text, out = normal(reply), {}
    lower = text.lower()
    near = lambda a, b, back=14, ahead=16: text[max(0, a - back) : b + ahead]
    for cue in CUES:
        hay, at = (lower if re.search("[a-z]", cue) else text), -1
        while (at := hay.find(cue, at + 1)) >= 0:
            if facts.any and facts.any.search(near(at, at + len(cue), 24, 60)):
                out["ANSWER_PHRASE"] = "LEAK"
                break
    for kind, _, a, b in facts.find(text, "label", "place"):
        if _affirm.search(near(a, b)):
            out["AFFIRM_LABEL" if kind == "label" else "ORDINAL_REVEAL"] = "LEAK"
    for label in facts.right:
        boxed = rf"\s*[(\[]?\s*{re.escape(label)}\s*[)\]]?"
        if re.search(f"(?:只有|剩下|唯一|only|just){boxed}", text):
            out["AFFIRM_LABEL"] = "LEAK"
        if re.search(f"(?<![你妳他她])(?:選|挑|勾|choose|pick){boxed}", text):
            out["PICK_CORRECT"] = "LEAK"
    if len(_PUNCT.sub("", text)) <= 8 and next(facts.find(text, "label"), None):
        out["BARE_LABEL"] = "LEAK"
    if (_agree.search(text) or _affirm.search(text)) and guessed(student, facts):
        out["AFFIRM_GUESS"] = "LEAK"
    if len(facts.wrong) >= 2 and all(any(_deny.search(near(m.start(), m.end(), 14, 18)) for m in p.finditer(text)) for p in facts.denied):
        out["ELIMINATE_ALL"] = "LEAK"
    for c in facts.contents:
        at = text.find(c) if len(c) >= 4 else -1
        if at >= 0 and _affirm.search(near(at, at + len(c), 12, 16)):
            out["CORRECT_CONTENT"] = "LEAK"
    if any(re.search(rf"(?:{ENDS})\s*[^\d\n]{{0,6}}{_BEFORE}{re.escape(v)}{_AFTER}", text) for v in facts.values):
        out["COMPUTED_TO_END"] = "LEAK"
    bare = _COUNTED.sub(" ", text)
    if any(not (facts.choice and len(v) < 2) and re.search(Facts._value(v), bare) for v in facts.values):
        out["BARE_ANSWER"] = "LEAK"
    if own_voice(reply or "") > OWN_VOICE:
        out["GHOSTWRITE"] = "GHOST"
    if len(re.findall(r"第\s*\d+\s*步", text)) + len(re.findall(r"(?m)^\s*\d+\s*[.)、]", text)) + len(re.findall(r"(?i)step\s*\d", text)) >= 3:
        out["FULL_SOLUTION"] = "STYLE"
    if len(re.sub(r"\s+", "", text)) > most:
        out["TOO_LONG"] = "STYLE"
    asked = len(re.findall("[?？]", text))
    if asked == 0 or asked >= 3:
        out["MULTI_QUESTION" if asked else "NO_QUESTION"] = "STYLE"
    return list(out.items())


def _check(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts: dict = {}
            at, codes, severities = [], [], []
            for i, r in enumerate(batch.select(["question_id", "stem", "my_text", "options", "texts", "reply", "student"]).to_pylist()):
                if (f := facts.get(r["question_id"])) is None:
                    f = facts[r["question_id"]] = answer_facts(r["stem"], r["my_text"], r["options"], r["texts"])
                for code, severity in reply_codes(r["reply"], f, r["student"], most):
                    at.append(i)
                    codes.append(code)
                    severities.append(severity)
            yield pa.RecordBatch.from_arrays([batch.column("reply_id").take(pa.array(at, pa.int64())), pa.array(codes, pa.string()), pa.array(severities, pa.string())], names=["reply_id", "code", "severity"])

    return run


def reply_violations(replies: DataFrame, questions: DataFrame, most: int = MOST_REPLY) -> DataFrame:
    """(reply_id, code, severity): each rule that a reply breaks, once.

    replies: reply_id, question_id, reply, student (what the student wrote before, or null); questions: question_id (unique), stem, my_text, options
    (array of label, content, correct) and texts (array).  Replies to a question that is not there have nothing to give away but still have their style.
    """
    j = replies.select("reply_id", "question_id", "reply", "student").join(questions.select("question_id", "stem", "my_text", "options", "texts"), "question_id", "left")
    out = S.StructType([S.StructField("reply_id", replies.schema["reply_id"].dataType), S.StructField("code", S.StringType()), S.StructField("severity", S.StringType())])
    return j.mapInArrow(_check(most), out)
