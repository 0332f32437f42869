"""Every rule on feedback by stated cases."""

from gradelake.operators import portfolio as P

STORY = "我參加了資訊社並且在社團裡學會了寫程式後來我帶著同學一起完成了一個專題作品並且拿到了不錯的名次"
TWO = "這份作品從題目發想到資料收集都有清楚的紀錄。圖表的安排也能看出對於主題的掌握與持續的修正與調整。"
CASES = [
    (STORY + "？", None, set()),
    (STORY + "。要補什麼？", None, {"FIRST_PERSON_RUN"}),
    (STORY + "。要補什麼？", "前面寫到，" + STORY + "，就這樣", set()),
    (STORY.replace("我", "該生") + "。要補什麼？", None, {"THIRD_PERSON_RUN"}),
    ("我從小喜歡看星星所以常常一個人去爬山露營和拍照。為什麼？", None, {"NARRATIVE_VOICE"}),
    ("從小喜歡看星星所以常常去爬山露營和拍照。為什麼？", None, set()),
    ("**我從小喜歡看星星（你可以換成別的）所以常常一個人去爬山露營和拍照**。為什麼？", None, {"NARRATIVE_VOICE"}),
    ("以下是一段，直接複製即可，好嗎？", None, {"GHOSTWRITE_LEAD"}),
    ("我沒有辦法幫你寫這一段，想先說哪件事？", None, set()),
    (TWO + "要補什麼？", None, {"PASTEABLE"}),
    (TWO.replace("。", "。你看，", 1) + "要補什麼？", None, set()),
    ("綜上所述，好嗎？", None, {"APPLICATION_VOICE"}),
    ("想一想。", None, {"NO_QUESTION"}),
    ("你" + "字" * 901 + "？", None, {"TOO_LONG"}),
    ("", None, set()),
    (None, "x", set()),
]


def test_stated_feedback(spark):
    df = spark.createDataFrame([(i, t, own, 1) for i, (t, own, _) in enumerate(CASES)], "feedback_id int, text string, own string, run int").repartition(3)
    got = {i: set() for i in range(len(CASES))}
    rows = P.feedback_violations(df).collect()
    for r in rows:
        got[r.feedback_id].add(r.code)
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert len(rows) == sum(len(w) for _, _, w in CASES)
    assert {r.code for r in rows if r.severity == "STYLE"} == {"NO_QUESTION", "TOO_LONG"}
    assert P.feedback_violations(df.limit(0)).count() == 0
    assert {r.code for r in P.feedback_violations(df, ask=False).collect()} == {r.code for r in rows} - {"NO_QUESTION"}


def test_told_uses_by_clause_order(spark):
    cases = [
        ("使用AI進行文字回饋，並整理素材", [True, True, False, False]),
        ("未使用AI，僅自行整理素材", [False, False, False, False]),
        ("使用AI進行回饋，未再修改，由本人整理面試", [False, False, False, False]),
        ("由本人整理，以人工智慧做模擬面試、選件", [False, False, True, True]),
        ("", [False] * 4),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    from pyspark.sql import functions as F

    assert {r.i: r.told for r in df.select("i", P.told_uses(F.col("t")).alias("told")).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_disclosure_edges(spark):
    s = spark.createDataFrame([(1, "由本人完成" + "字" * 300, 0), (2, "沒有使用AI工具，由本人完成，共0次", 0), (None, "由本人完成", 0)], "statement_id int, text string, total int")
    logs = spark.createDataFrame([(9, "WRITING_FEEDBACK"), (1, None), (1, "")], "statement_id int, feature string")
    got = sorted((str(r.statement_id), r.code, r.severity) for r in P.disclosure_violations(s, logs).collect())
    assert got == [("1", "SILENT_WHEN_UNUSED", "GHOST"), ("1", "TOO_LONG", "STYLE"), ("None", "SILENT_WHEN_UNUSED", "GHOST")]
    assert P.disclosure_violations(s.limit(0), logs).count() == 0
