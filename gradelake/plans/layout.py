"""Registered queries on pages, blocks, ids, figures, uploads and checked documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions.text import search_term
from ..operators import layout as L
from ..operators import validate as V
from ..sources import files
from ..sources import tables as T
from .grading import _stated
from .guards import _list, _pick

#: Stated documents as blocks (one a line) and the kinds of their blocks.
BLOCKS = [
    ("113 學年度試題\n一、單選題\n說明：第1題至第5題，每題2分\n1. 下列何者正確？\n續行\n(A) 甲\n乙續行\n(B) 丙", "HEADER_FOOTER,SECTION_HEADER,SECTION_NOTE,QUESTION_NO,QUESTION_NO,OPTION,OPTION,OPTION"),
    ("範例 3\n求值\n答：(B)\n解 設 x\n提示：用公式\n其餘", "EXERCISE_HEADER,STEM,ANSWER_KEY,EXPLANATION,TEACHING_NOTE,STEM"), ("第 2 頁\n\n3.5 公尺", "HEADER_FOOTER,HEADER_FOOTER,STEM"), ("7-8 為題組\n(a) 子題\n( C ) 7. To win\n①選項\n作答區", "GROUP_LEAD,STEM,QUESTION_NO,OPTION,ANSWER_AREA"),
]
#: Stated uploads: charset, bytes in front, text, what is read.
UPLOADS = [
    ("UTF-8", "", "名,分\r\n甲,\"1,5\"\r\n\r\n , \n", "utf-8:1:名/分|2:甲/1,5"), ("UTF-8", "EFBBBF", "a,b\rc,\"d\"\"e\"", "utf-8-bom:1:a/b|2:c/d\"e"), ("UTF-16LE", "FFFE", "座號\n\"x\ny\"", "utf-16le:1:座號|2:x\ny"), ("UTF-16BE", "FEFF", "k,v", "utf-16be:1:k/v"), ("BIG5", "", "姓名,國文\n王,90", "big5:1:姓名/國文|2:王/90"),
]


def block_kinds(s, d):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in BLOCKS]), (F.col("o_orderkey") % len(BLOCKS) + 1).cast("int"))
    b = T.scan(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("nth", "text"))
    g = L.block_kinds(b).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "kind"))).alias("k"))
    return g.select("doc_id", F.array_join(F.transform("k", lambda x: x["kind"]), ",").alias("result"))


def csv_uploads(s, d):
    """Each customer's upload: one of the stated files, by way of its bytes."""
    files_ = F.array(*[F.concat(F.unhex(F.lit(mark)), F.encode(F.lit(text), charset) if charset != "BIG5" else F.lit(bytearray(text.encode("big5")))) for charset, mark, text, _ in UPLOADS])
    c = T.scan(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.element_at(files_, (F.col("c_custkey") % len(UPLOADS) + 1).cast("int")).alias("content"))
    rows = files.parse_tables(c).groupBy("path", "encoding").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("r"))
    line = F.array_join(F.transform("r", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), F.array_join(x["cells"], "/"))), "|")
    return rows.select(F.col("path").cast("long").alias("c_custkey"), F.concat_ws(":", "encoding", line).alias("result"))


ALIASES = {"username": ["帳號", "學號", "user name"], "name": ["姓名", "Name"]}
HEADS = [["學號（必填）", "姓 名", "班"], ["NAME", " 帳號(登入) "], ["x", "name", "姓名"], ["User Name", "y"]]


def header_match(s, d):
    """Uploads whose header is one of four: the cells of the second row under the fields' names."""
    k = F.col("c_custkey")
    c = T.scan(s, d, "customer").select(k.cast("string").alias("path"), F.element_at(F.array(*[F.array(*[F.lit(h) for h in head]) for head in HEADS]), (k % len(HEADS) + 1).cast("int")).alias("head"))
    rows = c.select("path", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line"), F.col("head").alias("cells")), F.struct(F.lit(2).cast("long").alias("line"), F.transform("head", lambda x, i: F.concat(F.lit("c"), i.cast("string"))).alias("cells")))).alias("r")).select("path", "r.*")
    return files.named_columns(rows, ALIASES).select(F.col("path").cast("long").alias("c_custkey"), "username", "name")


def page_id_remap(s, d):
    """Line items as parts of scanned pages; every fourth refers to a part of the page of its order."""
    li = T.scan(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("doc_id"), (F.col("l_orderkey") % 200).alias("page"), _pick(["asset", "section", "group", "question"], F.col("l_partkey")).alias("kind"), F.concat(F.lit("no. "), (F.col("l_partkey") % 40).cast("string")).alias("raw"), "l_orderkey", "l_linenumber")
    refs = li.where("l_linenumber = 1").select("l_orderkey", "doc_id", "page", F.concat(F.lit("no. "), (F.col("l_orderkey") % 44).cast("string")).alias("raw"))
    return L.resolve(refs, li, ["asset", "section", "group", "question"], keep=True).select("l_orderkey", "id")


def asset_places(s, d):
    p = T.scan(s, d, "part").select(F.col("p_partkey").alias("question_id"))
    k = F.col("question_id")
    ref = lambda i: F.concat(F.lit("![[a:a"), (i % 6).cast("string"), F.lit("]]"))
    texts = p.select("question_id", F.explode(F.array(F.struct(F.lit("STIMULUS").alias("place"), F.when(k % 3 > 0, ref(k)).alias("text")), F.struct(F.lit("STEM").alias("place"), F.concat(ref(k + 2), F.lit(" and "), ref(k + 1)).alias("text")), F.struct(F.lit("A").alias("place"), F.when(k % 2 > 0, ref(k + 2)).otherwise("x").alias("text")))).alias("t")).select("question_id", "t.*")
    assets = p.select("question_id", F.posexplode(F.transform(F.sequence(F.lit(0), k % 5), lambda i: F.concat(F.lit("a"), i.cast("string")))).alias("nth", "asset"))
    return L.assets_in_place(texts, assets)


def _strokes(s, d):
    k = F.col("o_orderkey")
    return T.scan(s, d, "orders").select((k % 997).alias("page"), k.alias("stroke"), (k * 37 % 211).cast("double").alias("x0"), (k * 53 % 197).cast("double").alias("y0"), (k * 37 % 211 + k % 40 + 1).cast("double").alias("x1"), (k * 53 % 197 + k % 29 + 1).cast("double").alias("y1"))


def figure_clusters(s, d):
    return L.figures(_strokes(s, d))


def canonical_order(s, d):
    x = _strokes(s, d).select(F.col("page").alias("doc_id"), (F.col("stroke") % 3).alias("page"), (F.col("x0") / 7).alias("x"), F.when(F.col("stroke") % 10 > 0, F.floor(F.col("y0") / 9) / 7).alias("y"), F.col("stroke").alias("item"))
    return L.canonical_order(x).select("doc_id", "item", "place")


def commit_to_bank(s, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    c = T.scan(s, d, "lineitem").select((F.col("l_orderkey") % 300).alias("job_id"), k.alias("candidate_id"), _pick(["CONFIRMED", "CONFIRMED", "REJECTED", "FLAGGED"], k).alias("state"), F.col("l_partkey").alias("hash"))
    return L.bank_rows(c, T.scan(s, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("hash")))


def validate_documents(s, d):
    """Parts as documents of two questions with the faults that scans have."""
    k = F.col("p_partkey")
    option = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("content"))
    question = lambda id, stem, options, group: F.struct(F.lit(id).alias("id"), F.lit("SINGLE").alias("kind"), stem.alias("stem"), options.alias("options"), group.alias("group_id"), F.lit(None).cast("string").alias("section_id"), F.when(k % 4 > 0, F.array(F.lit("x"))).alias("asset_ids"), F.when(k % 11 == 0, "?du").otherwise("m").alias("unit_canonical"), F.lit(None).cast("struct<name:string,confirmed:boolean>").alias("custom_type"))
    questions = F.array(
        question("q1", F.when(k % 3 == 0, "see ![[a:x]]").otherwise(F.when(k % 7 == 0, "$1").otherwise(F.col("p_name"))), F.array(option("A", F.lit("one")), option("B", F.when(k % 5 == 0, " ONE ").when(k % 5 == 1, "").otherwise("two"))), F.when(k % 6 == 0, "g9").when(k % 6 == 1, "g1")),
        question("q2", F.lit("plain"), F.array().cast("array<struct<label:string,content:string>>"), F.lit(None).cast("string")),
    )
    groups = F.array(F.struct(F.lit("g1").alias("id"), F.lit(None).cast("string").alias("section_id"), F.lit("").alias("stimulus")))
    assets = F.when(k % 2 == 0, F.array(F.struct(F.lit("x").alias("id")))).otherwise(F.array().cast("array<struct<id:string>>"))
    docs = T.scan(s, d, "part").select(k.alias("doc_id"), questions.alias("questions"), groups.alias("groups"), F.lit(None).cast("array<struct<id:string>>").alias("sections"), assets.alias("assets"), F.lit(None).cast("array<struct<id:string,body:string,asset_ids:array<string>>>").alias("materials"))
    return V.validate_documents(docs)


#: Stems and whether they speak of a figure that only an asset can show.
STEMS = [("如右圖，求面積", True), ("求面積", False), ("圖中 4 秒的位置", True), ("代表中國的作物", False), ("見下表\n| a | b |", False), ("依附圖作答", True), ("以上表現優異", False), ("表一，求和", True), ("圖形表一圓", False), ("圖 2 所示", True)]


def question_faults(s, d):
    """Orders as questions of their customer's document: figures, numbers of printed answers, odd types."""
    k = F.col("o_orderkey")
    o = T.scan(s, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.cast("string").alias("id"), F.when(k % 6 == 0, "OTHER").otherwise("SINGLE").alias("kind"), _pick([t for t, _ in STEMS], k).alias("stem"), F.when(k % 4 == 0, F.array(F.lit("a1"))).alias("asset_ids"),
        F.when(k % 5 < 2, (k % 5).cast("string")).alias("group_id"), F.when(k % 3 > 0, (k % 3).cast("int")).alias("expected_count"), _pick(["PRINTED", "PRINTED", "SOLVED"], F.floor(k / 3)).alias("answer_source"), F.slice(F.array(F.lit("A"), F.lit("B")), 1, (F.floor(k / 9) % 3).cast("int")).alias("answer_keys"),
    )
    c = T.scan(s, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    groups = c.select("doc_id", F.lit("0").alias("id"), F.lit("see ![[a:x]]").alias("stimulus")).union(c.select("doc_id", F.lit("1"), F.lit("no picture")))
    return V.question_faults(o, groups, o.where("id % 12 = 0").select("doc_id", F.col("id").alias("question_id")))


def rubric_gaps(s, d):
    o = T.scan(s, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("rubric"), ((F.col("l_linenumber") - 1) * 4 + (F.col("l_orderkey") % 5 == 0).cast("int")).alias("low"), (F.col("l_linenumber") * 4 - 1 + (F.col("l_partkey") % 7 == 0).cast("int")).alias("high"), F.lit(11).alias("most"))
    return V.rubric_gaps(o, "rubric", "most")


def picks_and_confidence(s, d):
    k = F.col("o_orderkey")
    pick = lambda name, w: F.struct(F.lit(name).alias("kp"), w.cast("double").alias("weight"))
    picks = F.slice(F.array(pick("a", F.when(k % 2 == 0, 0.5).otherwise(0.25)), pick("b", F.lit(0.5)), pick("a", F.lit(0.25)), pick("c", F.lit(0.0))), 1, (k % 4 + 1).cast("int"))
    return T.scan(s, d, "orders").select("o_orderkey", V.picks_fault(picks).alias("fault"), V.adjusted_confidence(k % 20 / 20.0, F.when(k % 5 > 0, k % 6 / 5.0)).alias("confidence"))


def answer_states(s, d):
    """Whether something was answered, the verdict, shuffled keys as canonical ones, regraded and manual scores, and the search text."""
    k = F.col("o_orderkey")
    keys = F.slice(F.array(F.lit(2), F.lit(4)), 1, (k % 3).cast("int"))
    slots = F.when(k % 4 == 0, F.array(F.lit(" "), F.when(k % 8 == 0, "7").otherwise("")))
    earned = F.when(k % 5 > 0, (k % 4).cast("double"))
    answered = G.has_answer(keys, F.when(k % 6 == 0, " a ").otherwise("  "), slots)
    return T.scan(s, d, "orders").select(
        "o_orderkey", answered.alias("answered"), G.verdict(answered, earned, F.lit(3.0)).alias("verdict"), F.array_join(G.map_display_keys(keys, F.array(F.lit(3), F.lit(1), F.lit(4), F.lit(2))).cast("array<string>"), ",").alias("keys"),
        G.regrade(F.when(k % 7 == 0, 9.0), earned, F.when(k % 3 > 0, 1.0)).alias("score"), G.manual_score((k % 900) * 0.125 - 2, F.lit(100)).alias("manual"), search_term(F.concat(F.lit("  "), F.when(k % 9 > 0, F.repeat("o_orderpriority", (k % 12).cast("int"))).otherwise(""))).alias("term"),
    )


NAMES = [block_kinds, csv_uploads, header_match, page_id_remap, asset_places, figure_clusters, canonical_order, commit_to_bank, validate_documents, question_faults, rubric_gaps, picks_and_confidence, answer_states]
QUERIES = {f.__name__: f for f in NAMES}

_STROKES = """strokes AS (SELECT o_orderkey % 997 AS page, o_orderkey AS stroke, CAST(o_orderkey * 37 % 211 AS DOUBLE) AS x0, CAST(o_orderkey * 53 % 197 AS DOUBLE) AS y0, CAST(o_orderkey * 37 % 211 + o_orderkey % 40 + 1 AS DOUBLE) AS x1, CAST(o_orderkey * 53 % 197 + o_orderkey % 29 + 1 AS DOUBLE) AS y1 FROM orders)"""
_K = "l_orderkey * 7 + l_linenumber"
ORACLES = {
    "block_kinds": _stated(BLOCKS, "orders", "o_orderkey", "result", "o_orderkey AS doc_id"),
    "csv_uploads": _stated(UPLOADS, "customer", "c_custkey", "result", "c_custkey"),
    "header_match": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'c0' WHEN 1 THEN 'c1' WHEN 3 THEN 'c0' END AS username, CASE c_custkey % 4 WHEN 0 THEN 'c1' WHEN 1 THEN 'c0' WHEN 2 THEN 'c1' END AS name FROM customer",
    "page_id_remap": f"""WITH li AS (SELECT l_suppkey % 50 AS doc_id, l_orderkey % 200 AS page, l_partkey % 4 AS rank, {_list(['asset', 'section', 'group', 'question'], 'l_partkey')} AS kind, l_partkey % 40 AS raw, l_orderkey, l_linenumber FROM lineitem),
k AS (SELECT doc_id, page, raw, 'p' || page || left(kind, 1) || 'no' || raw AS id FROM li QUALIFY row_number() OVER (PARTITION BY doc_id, page, raw ORDER BY rank DESC) = 1)
SELECT l.l_orderkey, coalesce(k.id, 'no. ' || l.l_orderkey % 44) AS id FROM li l LEFT JOIN k ON k.doc_id = l.doc_id AND k.page = l.page AND k.raw = l.l_orderkey % 44 WHERE l_linenumber = 1""",
    "asset_places": """WITH r AS (SELECT p_partkey AS question_id, unnest([{'place': 'STIMULUS', 'at': 0, 'n': CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 6 END}, {'place': 'STEM', 'at': 0, 'n': (p_partkey + 2) % 6}, {'place': 'STEM', 'at': 1, 'n': (p_partkey + 1) % 6}, {'place': 'A', 'at': 0, 'n': CASE WHEN p_partkey % 2 > 0 THEN (p_partkey + 2) % 6 END}]) AS t FROM part),
refs AS (SELECT question_id, t.place AS place, t.at AS pos, t.n AS n FROM r WHERE t.n IS NOT NULL),
every AS (SELECT question_id, place, pos, n FROM refs WHERE n <= question_id % 5 UNION ALL SELECT p_partkey, 'STEM', 1000 + n, n FROM part, range(5) x(n) WHERE n <= p_partkey % 5 AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.question_id = p_partkey AND refs.n = x.n))
SELECT question_id, place, CAST(row_number() OVER (PARTITION BY question_id, place ORDER BY pos) AS INT) AS seq, 'a' || n AS asset FROM every UNION ALL SELECT question_id, place, NULL, 'a' || n FROM refs WHERE n > question_id % 5""",
    "figure_clusters": f"""WITH RECURSIVE {_STROKES}, links AS (SELECT a.page, a.stroke AS a, b.stroke AS b FROM strokes a JOIN strokes b ON a.page = b.page AND a.stroke <> b.stroke AND a.x0 - 9 < b.x1 AND a.x1 + 9 > b.x0 AND a.y0 - 9 < b.y1 AND a.y1 + 9 > b.y0),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, l.b FROM reach r JOIN sides l ON l.a = r.b), comp AS (SELECT a AS stroke, least(a, min(b)) AS figure FROM reach GROUP BY a)
SELECT page, figure, count(*) AS strokes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM strokes JOIN comp USING (stroke) GROUP BY 1, 2 HAVING count(*) >= 4 AND max(x1) - min(x0) >= 28 AND max(y1) - min(y0) >= 28""",
    "canonical_order": f"WITH {_STROKES} SELECT page AS doc_id, stroke AS item, CAST(row_number() OVER (PARTITION BY page ORDER BY stroke % 3, round_even(coalesce(CASE WHEN stroke % 10 > 0 THEN floor(y0 / 9) / 7 END, 0.0), 3), round_even(x0 / 7, 3), stroke) AS INT) AS place FROM strokes",
    "commit_to_bank": f"""WITH c AS (SELECT l_orderkey % 300 AS job_id, {_K} AS candidate_id, {_list(['CONFIRMED', 'CONFIRMED', 'REJECTED', 'FLAGGED'], _K)} AS state, l_partkey AS hash FROM lineitem)
SELECT job_id, candidate_id, CASE WHEN state = 'REJECTED' THEN 'REJECTED' WHEN state <> 'CONFIRMED' THEN 'WAITING' WHEN hash % 5 = 0 OR candidate_id > min(candidate_id) FILTER (state = 'CONFIRMED') OVER (PARTITION BY job_id, hash) THEN 'DUPLICATE' ELSE 'COMMIT' END AS action FROM c""",
    "validate_documents": " UNION ALL ".join(
        f"SELECT p_partkey AS doc_id, '{code}' AS code, '{ref}' AS ref FROM part WHERE {rule}" for code, ref, rule in [
            ("asset_not_listed", "q1", "p_partkey % 3 = 0 AND p_partkey % 4 = 0"), ("dangling_asset", "q1", "p_partkey % 2 = 1 AND (p_partkey % 4 > 0 OR p_partkey % 3 = 0)"), ("dangling_asset", "q2", "p_partkey % 2 = 1 AND p_partkey % 4 > 0"), ("content_markup", "q1", "p_partkey % 3 > 0 AND p_partkey % 7 = 0"),
            ("duplicate_options", "q1", "p_partkey % 5 = 0"), ("empty_option", "q1", "p_partkey % 5 = 1"), ("dangling_group", "q1", "p_partkey % 6 = 0"), ("orphan_group", "g1", "p_partkey % 6 <> 1"), ("unit_unparsed", "q1", "p_partkey % 11 = 0"), ("unit_unparsed", "q2", "p_partkey % 11 = 0"),
        ]),
    "rubric_gaps": """WITH b AS (SELECT l_orderkey AS rubric, (l_linenumber - 1) * 4 + CAST(l_orderkey % 5 = 0 AS INT) AS low, l_linenumber * 4 - 1 + CAST(l_partkey % 7 = 0 AS INT) AS high FROM lineitem WHERE l_linenumber <= 3), w AS (SELECT *, lag(high) OVER (PARTITION BY rubric ORDER BY low, high) AS before FROM b),
g AS (SELECT rubric, bool_or(low > before + 1) AS gap, bool_or(low <= before) AS overlap, min(low) <> 0 AS start, max(high) <> 11 AS finish FROM w GROUP BY 1)
SELECT rubric, 'GAP' AS code FROM g WHERE gap UNION ALL SELECT rubric, 'OVERLAP' FROM g WHERE overlap UNION ALL SELECT rubric, 'START' FROM g WHERE start UNION ALL SELECT rubric, 'END' FROM g WHERE finish""",
    "picks_and_confidence": """SELECT o_orderkey, CASE n WHEN 4 THEN 'TOO_MANY' WHEN 3 THEN 'REPEATED' ELSE CASE WHEN abs(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.25 END + CASE WHEN n > 1 THEN 0.5 ELSE 0 END - 1) > 0.02 THEN 'WEIGHTS' END END AS fault,
  least(1.0, greatest(0.0, CASE WHEN k IS NULL THEN c WHEN k >= 5 THEN c + 0.1::DOUBLE WHEN k >= 3 THEN c - 0.1::DOUBLE ELSE least(c, 0.3::DOUBLE) END)) AS confidence FROM (SELECT o_orderkey, o_orderkey % 4 + 1 AS n, o_orderkey % 20 / 20.0::DOUBLE AS c, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 6 END AS k FROM orders)""",
    "answer_states": """WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 3 > 0 OR o_orderkey % 6 = 0 OR o_orderkey % 8 = 0 AS answered, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 4 AS DOUBLE) END AS earned FROM orders)
SELECT o_orderkey, answered, CASE WHEN NOT answered THEN 'BLANK' WHEN earned IS NULL THEN 'PENDING' WHEN earned >= 3 THEN 'CORRECT' WHEN earned > 0 THEN 'PARTIAL' ELSE 'WRONG' END AS verdict, (['', '1', '1,2'])[o_orderkey % 3 + 1] AS keys,
  CASE WHEN o_orderkey % 7 = 0 THEN 9.0::DOUBLE ELSE coalesce(earned, CASE WHEN o_orderkey % 3 > 0 THEN 1.0::DOUBLE END) END AS score, CASE WHEN v BETWEEN 0 AND 100 AND floor(v * 100 + 0.5) = v * 100 THEN v END AS manual,
  nullif(trim(left(trim(CASE WHEN o_orderkey % 9 > 0 THEN repeat(o_orderpriority, o_orderkey % 12) ELSE '' END), 80)), '') AS term FROM (SELECT *, o_orderkey % 900 * 0.125::DOUBLE - 2 AS v FROM a)""",
}
_FIGURED = "([" + ", ".join("true" if x else "false" for _, x in STEMS) + f"])[o_orderkey % {len(STEMS)} + 1]"
ORACLES["question_faults"] = f"""SELECT o_custkey AS doc_id, unnest(list_filter([CASE WHEN {_FIGURED} AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN 'figure_missing' END,
  CASE WHEN o_orderkey % 3 > 0 AND o_orderkey // 3 % 3 < 2 AND o_orderkey // 9 % 3 > 0 AND o_orderkey // 9 % 3 <> o_orderkey % 3 THEN 'answer_count_mismatch' END, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 THEN 'other_without_issue' END], lambda x: x IS NOT NULL)) AS code, CAST(o_orderkey AS VARCHAR) AS ref FROM orders"""
