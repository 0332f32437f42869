"""Interview answers by stated cases."""

from pyspark.sql import functions as F

from gradelake.functions import interview as I

CASES = [
    ("", "為什麼選我們？", {"letters": 0, "unmet": ["一個理由"], "addressed": False}),
    (None, None, {"letters": 0, "unmet": [], "addressed": False, "found": []}),
    ("因為去年暑假我在科展做了三次實驗", "為什麼選我們？", {"unmet": [], "found": ["時間", "數量", "具名"], "addressed": True, "concrete": True}),
    ("我很喜歡", "怎麼準備的？", {"unmet": ["一段過程"]}),
    ("先看書，後來做題目", "如何準備？", {"unmet": [], "addressed": True}),
    ("就那件事", "哪一件事最難？", {"unmet": ["一個具體指名的東西"]}),
    ("「吉他社」的表演", "哪一件事最難？", {"unmet": [], "found": ["具名"], "concrete": False}),
    ("唱歌", "你有沒有參加過比賽？", {"unmet": ["一個明確的有或沒有"]}),
    ("我沒有參加過任何社團，在社團裡學到很多，獲益良多", "說說你自己", {"contradictions": ["說沒參加過又說在裡面學到"], "vague": 2}),
    ("完全沒有相關經驗，但是我做過專題", "說說你自己", {"contradictions": ["說沒經驗又舉了經驗"]}),
    ("字" * 601, "說說你自己", {"letters": 601}),
]


def test_stated_answers(spark):
    df = spark.createDataFrame([(i, a, q) for i, (a, q, _) in enumerate(CASES)], "i int, a string, q string")
    got = {r.i: r.r.asDict() for r in df.select("i", I.structure_feedback("a", "q", F.lit(None).cast("array<string>")).alias("r")).collect()}
    for i, (_, _, want) in enumerate(CASES):
        assert {k: got[i][k] for k in want} == want, CASES[i]
    assert got[0]["ask"] == ["FORM:一個理由", "WHEN", "HOW_MANY", "TOO_SHORT"]
    assert got[10]["ask"] == ["WHEN", "HOW_MANY", "TOO_LONG"]
