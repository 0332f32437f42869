"""Every rule on tutor replies by stated cases, and the join with questions."""

import pytest

from gradelake.operators import tutor as U

OPTIONS = [{"label": f"({i})", "content": c, "correct": i == 3} for i, c in enumerate(["12 公尺", "16 公尺", "24 公尺", "30 公尺"], 1)]
WORDS = [{"label": x, "content": c, "correct": x == "C"} for x, c in zip("ABCD", ["which", "where", "whatever", "then"])]
TWO = [{"label": "A", "content": "1", "correct": True}, {"label": "B", "content": "2", "correct": True}, {"label": "C", "content": "3", "correct": False}]
LONG = "我在高一的時候參加了學校的資訊社並且在社團裡學會了寫程式後來我帶著同學一起完成了一個專題作品。"

CASES = [
    (OPTIONS, None, "答案是 (3) 嗎？請回頭看看你寫的算式", None, ["ANSWER_PHRASE"]),
    (OPTIONS, None, "答案很簡單。就是第三個，對嗎？", None, ["ANSWER_PHRASE"]),
    (OPTIONS, None, "(3) 是對的，為什麼？請回頭看看你寫的算式", None, ["AFFIRM_LABEL"]),
    (OPTIONS, None, "(3) 不是對的嗎？請回頭看看你寫的算式", None, []),
    (OPTIONS, None, "只有（３）成立，對嗎？請回頭看看你寫的算式", None, ["AFFIRM_LABEL"]),
    (OPTIONS, None, "你選的 (3) 是怎麼想的？", None, []),
    (OPTIONS, None, "那就挑 (3) 看看？請回頭看看你寫的算式", None, ["PICK_CORRECT"]),
    (OPTIONS, None, "(3)？", None, ["BARE_LABEL"]),
    (OPTIONS, None, "第三個敘述成立嗎？", None, []),
    (OPTIONS, None, "第三個敘述成立，怎麼看出來的？", None, ["ORDINAL_REVEAL"]),
    (OPTIONS, None, "(1) 不對，(2) 不成立，(4) 也不行，還剩什麼？", None, ["ELIMINATE_ALL"]),
    (OPTIONS, None, "(1) 不對，(2) 呢？", None, []),
    (OPTIONS, None, "對，就是這樣，接下來？", "那 (3) 對不對", ["AFFIRM_GUESS"]),
    (OPTIONS, None, "對，就是這樣，接下來？", "我這一步算對嗎", []),
    (OPTIONS, None, "所以 24 公尺才對，為什麼？", None, ["CORRECT_CONTENT", "BARE_ANSWER"]),
    (OPTIONS, None, "∴ x = \\boxed{24}？", None, ["ANSWER_PHRASE", "COMPUTED_TO_END", "BARE_ANSWER"]),
    (WORDS, None, "答案是 whatever 那個嗎？", None, ["ANSWER_PHRASE"]),
    (WORDS, None, "whatever 跟 which 差在哪裡？", None, []),
    (WORDS, None, "C is correct, why?", None, ["AFFIRM_LABEL"]),
    (WORDS, None, "Can you say more?", None, []),
    (TWO, None, "A 沒錯，B 呢？請回頭看看你寫的算式", None, ["AFFIRM_LABEL"]),
    (None, ["24"], "等於二十四嗎？", None, ["ANSWER_PHRASE", "COMPUTED_TO_END", "BARE_ANSWER"]),
    (None, ["24"], "還有 24 個步驟，先看哪一個？", None, []),
    (None, ["24"], "看看 240 和 1/24？", None, []),
    (None, ["3/4"], "\\frac{3}{4} 怎麼來的？", None, ["BARE_ANSWER"]),
    (None, ["x+1"], "x+1 怎麼來的？", None, ["BARE_ANSWER"]),
    (None, ["60"], "等你想六十分鐘再回來？", None, []),
    (None, None, LONG + "這樣可以嗎？", None, ["GHOSTWRITE"]),
    (None, None, "你" + LONG + "這樣可以嗎？", None, []),
    (None, None, "第 1 步。第 2 步。第 3 步？", None, ["FULL_SOLUTION"]),
    (None, None, "字" * 351 + "？", None, ["TOO_LONG"]),
    (None, None, "想一想。", None, ["NO_QUESTION"]),
    (None, None, "甲？乙？丙？", None, ["MULTI_QUESTION"]),
    (None, None, None, None, ["NO_QUESTION"]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_stated_replies(i):
    options, texts, reply, student, want = CASES[i]
    facts = U.answer_facts("這一題 7 分，共有 16 位", None, options, texts)
    assert sorted(c for c, _ in U.reply_codes(reply, facts, student)) == sorted(want)


def test_facts():
    f = U.answer_facts("有 24 個人", "我寫 30", OPTIONS, None)
    assert f.right == ["3"] and f.wrong == ["1", "2", "4"] and f.places == [3] and f.values == []
    assert U.answer_facts("x", None, None, ["二十四 公尺", "24"]).values == ["24 公尺", "24"]
    assert U.normal("（３）　\\frac{1}{2} twenty-four") == "(3) 1/2 24"


def test_through_spark(spark):
    kinds = "question_id int, stem string, my_text string, options array<struct<label: string, content: string, correct: boolean>>, texts array<string>"
    questions = spark.createDataFrame([(i, "這一題 7 分，共有 16 位", None, o and [tuple(x.values()) for x in o], t) for i, (o, t, *_) in enumerate(CASES)], kinds)
    replies = spark.createDataFrame([(i, i, r, s) for i, (_, _, r, s, _) in enumerate(CASES)] + [(900, None, "好嗎？", None), (901, 77_777, "好。", None)], "reply_id int, question_id int, reply string, student string").repartition(3)
    got = {}
    for x in U.reply_violations(replies, questions).collect():
        got.setdefault(x.reply_id, []).append(x.code)
    want = {i: sorted(w) for i, (*_, w) in enumerate(CASES) if w} | {901: ["NO_QUESTION"]}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert U.reply_violations(replies.limit(0), questions).count() == 0
