"""Whether feedback on a portfolio is feedback, or text to paste into it.

Texts are cut into sentences and those into runs: sentences of a paragraph that follow each other and neither ask nor speak to the reader.  A
run that the writer's own text covers is a quotation and may stand.  Phrases that offer to write do not count where they are refused just before.
Sentences are rows and runs are windows over them, so texts of any length spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import let
from ..functions.text import FULL, HALF, condensed

#: Where sentences end, who speaks, who is spoken of and to, time words, and how long a run may be.
SENTENCE = r"""(?<=[。！？!?；;：:\n])|(?<=[A-Za-z\x{4E00}-\x{9FFF})\]”’"'][.])(?=\s|$)|(?=[「『"“])"""
FIRST, READER = r"(?i)[我吾]|本人|筆者|敝人|\bI\b|\bmy\b|\bme\b", r"(?i)[你妳您]|\byou\b|\byour\b"
STUDENT = "該(?:生|童)|該名?(?:學生|同學)|這[位名](?:學生|同學)|學生本人"
OTHER = f"{STUDENT}|(?<!其)[他她]"
TIMES = "高[一二三123]|高中|國中|國小|[一二三]年級|從小|自小|那時|當時|那次|那年|那段|三年來|這三年|升上|學期|從那之後|第一次|一開始"
LETTER = "貴(?:系|校|所|院|中心)|敝人|職涯規劃如下|綜上所述|由此可見|承上所述|職是之故|準此"
OFFERS = [
    "(?:你|妳|您)?可以(?:這樣|這麼|如此)(?:寫|說|表達|描述|陳述)|可以(?:這樣|這麼)?(?:寫|說)[：:「『]", "(?:幫|替|為)(?:你|妳|您)(?:把[^。；;：:]{0,12})?(?:寫|撰寫|草擬|擬|生成|產出|完成|潤飾|潤稿|改寫|重寫|修改)", "參考(?:範例|範文|例句|寫法|版本)|範例(?:如下)?[：:]|範文|樣稿|模板|範本",
    "(?:修改|改寫|潤飾|優化|調整|重寫)(?:後|過)(?:的)?(?:版本|內容|段落|文字|如下)", "以下(?:是|為|提供)(?:一段|一篇|我(?:幫|為)你)?", "建議(?:改|寫|改寫|修改)(?:成|為)[：:「『]", "直接(?:複製|貼上|拿去用|套用|使用即可|使用)", "(?:試著|不妨)(?:這樣|這麼)(?:寫|說|表達)", "一鍵(?:套用|採用|帶入)|採用此版本",
    "(?:草稿|初稿|全文|內容)(?:如下|如右|在下面)[：:]?", "第[一二三四1234](?:段|部分)(?:可以|建議|不妨)(?:這樣|這麼)?(?:寫|開頭|描述)?[：:]",
]
REFUSED = "[不沒無別]|拒絕|不能|不會|無法|沒有辦法"
OWN_SHARE, RUN, SHORT_RUN, PASTE, MOST = 0.82, 40, 20, 40, 900


def _letters(text) -> Column:
    """How many characters are neither white space nor punctuation nor symbols."""
    return F.length(F.regexp_replace(text, r"[\s\x{3000}\p{P}\p{S}]+", ""))


def normal(text: Column) -> Column:
    """Half width, without bold and heading marks, and without brackets that speak to the reader (a common way to hide a story)."""
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), FULL, HALF), r"\*+|(?m)^#+\s*", "")
    t = F.regexp_replace(t, "[(【][^)】]{0,60}[你妳您][^)】]{0,60}[)】]", "")
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def narrative_runs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, run, said, letters, sentences): runs of sentences that neither ask nor speak to the reader."""
    p = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[\r\n]+")).alias("paragraph", "p"))
    s = p.select(key, "paragraph", F.posexplode(F.filter(F.transform(F.split("p", SENTENCE), lambda x: F.regexp_replace(x, r"^[\s\x{3000}]+|[\s\x{3000}]+$", "")), lambda x: x != "")).alias("nth", "s"))
    ends = F.col("s").rlike(r"[？?]$") | F.col("s").rlike(READER)
    s = s.withColumn("ends", ends).withColumn("run", F.sum(ends.cast("int")).over(Window.partitionBy(key, "paragraph").orderBy("nth"))).where(~F.col("ends"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "s"))), lambda x: x["s"]), "")
    g = s.groupBy(key, "paragraph", "run").agg(said.alias("said"), F.count("*").alias("sentences"))
    return g.withColumn("letters", _letters("said"))


def own_cover(said: Column, own: Column) -> Column:
    """The share of a run's places whose four characters the writer's own text has too; 0 below eight characters.

    Both texts are worked out once, not at each place.
    """
    def share(t: Column, o: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(t) - 3)
        return F.when(F.length(t) < 8, 0.0).otherwise(F.size(F.filter(places, lambda i: F.contains(o, F.substring(t, i, F.lit(4))))) / (F.length(t) - 3))

    return let(F.struct(said.alias("said"), own.alias("own")), lambda x: share(x["said"], x["own"]))


def _offers(text: Column) -> Column:
    """Some phrase offers to write, where it first stands, and is not refused in the eight characters before."""
    hit = F.lit(False)
    for pattern in OFFERS:
        ahead = F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)
        hit = hit | (text.rlike(pattern) & ~F.substring(ahead, F.greatest(F.length(ahead) - 7, F.lit(1)), F.lit(8)).rlike(REFUSED))
    return hit


def feedback_violations(feedback: DataFrame, most: int = MOST, ask: bool = True) -> DataFrame:
    """(feedback_id, code, severity): each rule that a feedback breaks, once; GHOST is text to paste, STYLE may stand after one more try.

    feedback: feedback_id (unique), text, own (all that the student wrote, or null).  A null or empty text breaks nothing.
    """
    f = feedback.select("feedback_id", normal(F.col("text")).alias("text"), condensed("own").alias("own"))
    runs = narrative_runs(f, "feedback_id", "text").join(f.select("feedback_id", "own"), "feedback_id")
    said = F.col("said")
    bare = condensed("said")
    runs = runs.where("letters >= 20").withColumn("quoted", own_cover(bare, F.col("own")) >= OWN_SHARE).where("not quoted")
    named = said.rlike(FIRST) | said.rlike(OTHER)
    of_runs = {
        "FIRST_PERSON_RUN": said.rlike(FIRST) & (F.col("letters") > RUN),
        "THIRD_PERSON_RUN": said.rlike(STUDENT) & (F.col("letters") > RUN),
        "NARRATIVE_VOICE": said.rlike(TIMES) & (F.col("letters") >= F.when(named, SHORT_RUN).otherwise(RUN)),
        "PASTEABLE": (F.col("sentences") >= 2) & (F.col("letters") >= PASTE),
    }
    text = F.col("text")
    of_texts = {"GHOSTWRITE_LEAD": _offers(text), "APPLICATION_VOICE": text.rlike(LETTER), "TOO_LONG": _letters("text") > most}
    if ask:
        of_texts["NO_QUESTION"] = (_letters("text") > 0) & ~text.rlike("[？?]")
    codes = lambda rules: F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))).alias("code")
    out = runs.select("feedback_id", codes(of_runs)).distinct().unionAll(f.select("feedback_id", codes(of_texts)))
    return out.withColumn("severity", F.when(F.col("code").isin("TOO_LONG", "NO_QUESTION"), "STYLE").otherwise("GHOST"))


#: Uses that must be told, and how a statement tells each; words for the tool, for denial and for one's own work.
FEATURES = {
    "WRITING_FEEDBACK": "具體性|一致性|文字(?:的)?回饋|撰寫(?:的)?(?:回饋|建議|意見)|修改建議|文句(?:的)?檢視|針對(?:初稿|草稿|文稿)", "MATERIAL_HINT": "素材|學習(?:歷程)?紀錄(?:的)?(?:回想|提問)|回想|學習軌跡|成績(?:的)?變化|經歷(?:的)?整理",
    "SELECTION_DISCUSS": "選件|成果(?:的)?(?:挑選|選擇|討論)|件數(?:的)?討論|作品(?:的)?挑選|哪幾件", "INTERVIEW_FEEDBACK": "面試|口試|回答(?:的)?結構|模擬(?:面試|問答)",
}
TOOL, DENIED = "(?i)AI|人工智慧|生成式|智慧工具", "[未無]|沒有|不曾|從未|並非|不是|皆非"
BY_ONESELF = "由本人|本人(?:自行|獨力|獨立|親自|反覆)?(?:完成|撰寫|檢視|進行|整理|判斷)|自行(?:完成|撰寫|檢視|進行|整理|判斷)"
NO_USE = "(?i)(?:未|沒有|不曾|從未|無)(?:使用|借助|運用|透過|藉由)(?:任何)?(?:AI|人工智慧|生成式|智慧)(?:輔助)?(?:工具|技術|軟體)?(?=[，,、；;。.]|$)"
NOT_MADE = "(?i)(?:未|沒有|不曾|無)(?:使用|藉由|透過|讓)?(?:AI|人工智慧|生成式(?:AI|工具)?)(?:工具)?(?:生成|產生|撰寫|代寫|產出)"
MADE = "(?i)(?:由|經)(?:AI|人工智慧|生成式)[^。；;]{0,12}(?:生成|撰寫|代寫|完成|產出)|AI(?:代寫|生成(?:了)?(?:本文|內容|全文|草稿))"
OWN_WORK = "由本人(?:獨立)?(?:完成|撰寫|構思)|本人(?:自行|獨力|獨立)(?:完成|撰寫)|構思(?:與|及)撰寫(?:均)?由本人"
MOST_STATEMENT = 300


def told_uses(text: Column) -> Column:
    """Which of ``FEATURES`` a statement tells as something the tool did (array of booleans).

    Clauses are read in order.  One that names the tool speaks of it unless a denial stands before the name; those after it go on so until one
    speaks of the writer's own work.
    """
    clauses = F.filter(F.split(text, "[，,、；;。.]+"), lambda c: c != "")
    kinds = "struct<on:boolean,told:array<boolean>>"

    def read(so: Column, clause: Column) -> Column:
        ahead = F.regexp_extract(clause, f"(?i)^(.*?)(?:{TOOL.removeprefix('(?i)')})", 1)
        on = F.when(clause.rlike(TOOL), ~ahead.rlike(DENIED)).when(clause.rlike(BY_ONESELF), False).otherwise(so["on"])
        return F.struct(on.alias("on"), F.array(*[so["told"][i] | (on & clause.rlike(p)) for i, p in enumerate(FEATURES.values())]).alias("told")).cast(kinds)

    start = F.struct(F.lit(False).alias("on"), F.array(*[F.lit(False)] * len(FEATURES)).alias("told")).cast(kinds)
    return F.aggregate(clauses, start, read)["told"]


def disclosure_violations(statements: DataFrame, logs: DataFrame, most: int = MOST_STATEMENT) -> DataFrame:
    """(statement_id, code, severity): where a statement on the use of AI departs from the log of that use.

    statements: statement_id (unique), text; logs: statement_id, feature (one row a use; blank ones do not count).  A statement without a log was
    written without any use; a null text is empty.
    """
    n = {f: F.count_if(F.col("feature") == f).alias(f"n_{i}") for i, f in enumerate(FEATURES)}
    used = logs.where(F.trim(F.coalesce("feature", F.lit(""))) != "").groupBy("statement_id").agg(F.count("*").alias("total"), *n.values())
    columns = ["total", *[f"n_{i}" for i in range(len(FEATURES))]]
    s = statements.select("statement_id", F.regexp_replace(normal(F.col("text")), r"\s+", "").alias("text")).join(used, "statement_id", "left").fillna(0, columns)
    s = s.withColumn("told", told_uses(F.col("text")))
    text, counts = F.col("text"), [F.col(c) for c in columns[1:]]
    told = [F.col("told")[i] for i in range(len(counts))]
    any_ = lambda xs: F.greatest(*xs)
    stated = F.nullif(F.regexp_extract(text, "共([0-9]+)次", 1), F.lit("")).cast("decimal(38,0)")
    ahead = F.regexp_extract(text, f"(?is)^(.*?)(?:{MADE.removeprefix('(?i)')})", 1)
    refused = F.substring(ahead, F.greatest(F.length(ahead) - 5, F.lit(1)), F.lit(6)).rlike("[不沒無未非]")
    rules = {
        "CLAIMS_NO_AI": any_([c > 0 for c in counts]) & text.rlike(NO_USE),
        "OMITS_FEATURE": any_([(c > 0) & ~t for c, t in zip(counts, told, strict=True)]),
        "CLAIMS_UNUSED_FEATURE": any_([(c == 0) & t for c, t in zip(counts, told, strict=True)]),
        "MISCOUNTS": (stated != sum(counts, F.lit(0))) & ~any_([stated == c for c in counts]),
        "CLAIMS_GENERATION": text.rlike(MADE) & ~refused,
        "SILENT_WHEN_UNUSED": (F.col("total") == 0) & ~text.rlike(NO_USE) & ~text.rlike(NOT_MADE),
        "EMPTY": _letters("text") == 0,
        "NO_OWN_WORK_CLAIM": ~text.rlike(OWN_WORK),
        "TOO_LONG": _letters("text") > most,
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    out = s.select("statement_id", F.explode(codes).alias("code"))
    return out.withColumn("severity", F.when(F.col("code").isin("NO_OWN_WORK_CLAIM", "TOO_LONG"), "STYLE").otherwise("GHOST"))
