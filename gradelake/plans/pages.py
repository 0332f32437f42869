"""Registered queries on the layout of pages: reading order, kinds of blocks, joined pages, sections and exercises, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission
from ..operators import layout as L
from ..operators import reading as R
from ..operators import segments as S
from ..sources import files
from ..sources import tables as T
from ..sources import versions as V
from ..sources.shared import new_path
from .guards import _list, _pick

#: How the blocks of a page lie, by its number: what it has above and below, and its columns (left edge, right edge; the last ones may stand under a heading of their own).
LAYOUTS = [
    {"title": False, "foot": False, "columns": [(0.12, 0.9)], "labels": True, "heading": None},
    {"title": True, "foot": False, "columns": [(0.08, 0.472), (0.531, 0.92)], "labels": False, "heading": None},
    {"title": False, "foot": True, "columns": [(0.05, 0.622), (0.683, 0.95)], "labels": False, "heading": None},
    {"title": True, "foot": False, "columns": [(0.05, 0.321), (0.372, 0.631), (0.682, 0.95)], "labels": False, "heading": None},
    {"title": False, "foot": False, "columns": [(0.05, 0.352), (0.401, 0.652), (0.703, 0.95)], "labels": False, "heading": (0.401, 0.95)},
]


def _laid_out():
    """(layout, zone, column, part, x0, x1, y0, y1): y as numbers or, for a row r of a column, as shares of its band (null zone numbers none)."""
    out = []
    for k, page in enumerate(LAYOUTS):
        if page["title"]:
            out.append((k, 0, 0, 0, 0.1, 0.9, 0.02, 0.05))
        if page["foot"]:
            out.append((k, 9, 0, 0, 0.05, 0.95, 0.92, 0.97))
        if page["heading"]:
            out.append((k, 1, 1, 0, *page["heading"], 0.11, 0.14))
        for c, (a, b) in enumerate(page["columns"]):
            zone = 1 if not page["heading"] or c == 0 else 2
            if page["labels"]:
                out.append((k, 1, c, -1, 0.04, 0.1, None, None))
            out.append((k, zone, c, 1, a, b, None, None))
    return out


_AT = ["layout", "zone", "col", "part", "left", "right", "top", "bottom"]


def reading_order(s, d):
    """Orders as pages of five layouts (labels beside lines, a title over columns, unequal columns over a figure, three columns, a column beside two under a heading)."""
    at = s.createDataFrame(_laid_out(), "layout int, zone int, col int, part int, left double, right double, top double, bottom double")
    o = T.scan(s, d, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 5).cast("int").alias("layout"), (3 + F.col("o_custkey") % 5).cast("int").alias("lines"))
    b = o.join(F.broadcast(at), "layout").withColumn("line", F.explode(F.when(F.col("top").isNull(), F.sequence(F.lit(0), F.col("lines") - 1)).otherwise(F.array(F.lit(0)))))
    high = F.lit(0.15) + F.col("line") * 0.1
    jut = F.when(F.col("part") == 1, (F.col("line") % 3) * 0.01).otherwise(0.0)
    b = b.select(
        "page", ((F.col("zone") * 7 + F.col("col") * 5 + F.col("part") * 3 + F.col("line") * 11 + 100) * 1000 + F.col("zone") * 100 + F.col("col") * 10 + F.col("part") + 1).alias("block"), F.col("left").alias("x0"), (F.col("right") - jut).alias("x1"),
        F.coalesce("top", high + F.when(F.col("part") < 0, 0.02).otherwise(0.0)).alias("y0"), F.coalesce("bottom", high + F.when(F.col("part") < 0, 0.05).otherwise(0.08)).alias("y1"), "zone", "col", "line", "part",
    )
    return R.reading_order(b.select("page", "block", "x0", "y0", "x1", "y1"))


#: How a block begins and what kind that makes it; GOES_ON stands for a line that only goes on.
BEGINNINGS = [
    ("範例 3", "", "EXERCISE_HEADER"), ("範例 3 求 x", " ", "GOES_ON"), ("答：", "x", "ANSWER_KEY"), ("解 設", " ", "EXPLANATION"), ("◎ 搭配", " ", "HEADER_FOOTER"), ("說明：第1題至第5題", " ", "SECTION_NOTE"), ("說明： 如右圖", " ", "TEACHING_NOTE"), ("2. 點斜式：", "", "CONCEPT"), ("【詳解】", " ", "EXPLANATION"),
    ("- 12 -", "", "HEADER_FOOTER"), ("37-39 為題組", " ", "GROUP_LEAD"), ("請回答第 11 至 12 題", " ", "GROUP_LEAD"), ("第壹部分", "、", "SECTION_HEADER"), ("一、單選題", " ", "SECTION_HEADER"), ("文法選擇", "", "SECTION_HEADER"), ("作答區", "", "ANSWER_AREA"), ("1.(3) 2.(5) 3.(1)", " ", "ANSWER_AREA"), ("（a）", " ", "STEM"),
    ("( C ) 7. ", " ", "QUESTION_NO"), ("(C) ", " ", "OPTION"), ("(12) ", " ", "QUESTION_NO"), ("12、", " ", "QUESTION_NO"), ("4.5 公尺", " ", "GOES_ON"), ("plain", " ", "GOES_ON"), ("and so on", " ", "GOES_ON"),
]


def block_kinds_table(s, d):
    """Orders as blocks of their customer's document: a beginning, a word behind it."""
    k = F.col("o_orderkey") * 7 + F.col("o_custkey")
    gap = _pick([b for _, b, _ in BEGINNINGS], k)
    rest = F.when(gap == "", "").otherwise(F.concat(gap, F.lit("mode"), (F.col("o_orderkey") % 7).cast("string")))
    b = T.scan(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("nth"), F.concat(_pick([a for a, _, _ in BEGINNINGS], k), rest).alias("text"))
    return L.block_kinds(b).select("doc_id", "nth", "kind")


_KINDS = ["STEM", "STEM", "OPTION", "OPTION", "QUESTION_NO", "STEM", "SECTION_NOTE", "SECTION_HEADER", "HEADER_FOOTER", "GROUP_LEAD", "STEM", "SECTION_HEADER"]
_WORK = ["STEM", "EXERCISE_HEADER", "STEM", "EXPLANATION", "STEM", "EXPLANATION", "ANSWER_KEY", "TEACHING_NOTE", "HEADER_FOOTER", "OPTION", "STEM"]
_ENDS = ["甲乙", "word", "丙。  ", "end "]


def _blocks(s, d):
    """Orders as blocks: four customers' are a document, pages by order number."""
    n = F.col("o_orderkey")
    return T.scan(s, d, "orders").select(
        F.expr("o_custkey div 4").alias("doc_id"), F.expr("o_orderkey div 300").alias("page"), n.alias("nth"), (F.col("o_custkey") * 7 + n * 3).alias("k"), F.when(n % 4 > 0, 0.05).otherwise(0.5).alias("y0"), F.when(n % 3 > 0, 0.95).otherwise(0.6).alias("y1"),
        F.concat(F.lit("mode"), (n % 7).cast("string")).alias("mode"),
    )


def page_merge(s, d):
    """Blocks that a page's end cuts in two, joined: three kinds, so that both halves often agree."""
    b = _blocks(s, d).select("doc_id", "page", "nth", _pick(["STEM", "STEM", "OPTION", "STEM", "HEADER_FOOTER"], F.col("k")).alias("kind"), F.concat("mode", _pick(_ENDS, F.col("k") + F.col("nth"))).alias("text"), "y0", "y1")
    return S.merge_pages(S.mark_page_cuts(b)).select("doc_id", "nth", "page", "kind", "text", "parts")


def _paper(s, d):
    kind = _pick(_KINDS, F.col("k") + F.col("nth"))
    part = F.when((kind == "SECTION_HEADER") & (F.col("k") % 3 == 0), "第貳部分 ").otherwise("")
    return _blocks(s, d).select("doc_id", "nth", kind.alias("kind"), F.concat(part, "mode", (F.col("k") % 10).cast("string")).alias("text"))


def section_table(s, d):
    return S.split_sections(_paper(s, d))[0]


def section_members(s, d):
    return S.split_sections(_paper(s, d))[1].select("doc_id", "section", "nth", "kind")


def _worksheet(s, d):
    k = F.col("k")
    kind = _pick(_WORK, k + F.col("nth"))
    text = F.when((kind == "EXPLANATION") & (k % 2 == 0), "解").when(kind == "EXPLANATION", F.concat(F.lit("解 "), "mode")).when(kind == "ANSWER_KEY", F.concat(F.lit("答： "), "mode", F.lit(" 。"))).otherwise(F.col("mode"))
    return _blocks(s, d).select("doc_id", "nth", "page", kind.alias("kind"), text.alias("text"), F.when(k % 4 == 0, F.array(F.lit("(B)"))).alias("answers"))


def exercise_table(s, d):
    return S.split_exercises(_worksheet(s, d))[0].select("doc_id", "unit", "label", "page", "answer")


def exercise_members(s, d):
    return S.split_exercises(_worksheet(s, d))[1].select("doc_id", "unit", "part", "place", "kind", "text")


def page_replace(s, d):
    """Pages of orders written, a third of them replaced (every seventh by nothing), that again, and a writer lost before its commit."""
    o = T.scan(s, d, "orders").select(F.expr("o_custkey div 4").alias("doc_id"), F.expr("o_orderkey div 300").alias("page"), F.col("o_orderkey").alias("block"), F.lit("first").alias("text"))
    path, keys = new_path(s, "pages"), ["doc_id", "page"]
    again = o.where("(doc_id + page) % 3 = 0")
    second = again.where("(doc_id + page) % 7 > 0").withColumn("text", F.lit("second"))
    V.replace_parts(o, o.select(*keys), path, 1)
    for _ in range(2):
        V.replace_parts(second, again.select(*keys), path, 2)
    V.replace_parts(o.withColumn("text", F.lit("lost")), o.select(*keys), path, 3, stop_before_commit=True)
    return V.current(s, path, o.schema, keys)


def rank_import_table(s, d):
    """Ranks of customers imported as a whole per class, then one class in five anew: the table that is left."""
    c = T.scan(s, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 100).alias("percentile"))
    path = new_path(s, "ranks")
    V.replace_parts(c, c.select("class"), path, 1)
    anew = c.where("class % 5 = 0")
    V.replace_parts(anew.where("user_id % 2 = 0").withColumn("percentile", F.col("percentile") + 1000), anew.select("class"), path, 2)
    V.vacuum(s, path, c.schema, ["class"], 3)
    return V.current(s, path, c.schema, ["class"])


def file_kinds(s, d):
    """Uploads by their first bytes."""
    starts = [bytes.fromhex(m) for m in files.MAGIC.values()] + [b"RIFF1234WEBPVP8", b"RIFF1234WAVEfmt", b"plain", b""]
    return T.scan(s, d, "orders").select("o_orderkey", files.file_kind(F.concat(_pick([bytearray(b) for b in starts], F.col("o_orderkey")), F.encode(F.col("o_orderpriority"), "utf-8"))).alias("kind"))


def admission_years(s, d):
    return T.scan(s, d, "orders").select("o_orderkey", admission.roc_year(F.col("o_orderdate")).alias("year"))


NAMES = [page_replace, rank_import_table, file_kinds, admission_years, reading_order, block_kinds_table, page_merge, section_table, section_members, exercise_table, exercise_members]
QUERIES = {f.__name__: f for f in NAMES}

_BLOCKS = "b0 AS (SELECT o_custkey // 4 AS doc_id, o_orderkey // 300 AS page, o_orderkey AS nth, o_custkey * 7 + o_orderkey * 3 AS k, CASE WHEN o_orderkey % 4 > 0 THEN 0.05 ELSE 0.5 END AS y0, CASE WHEN o_orderkey % 3 > 0 THEN 0.95 ELSE 0.6 END AS y1, 'mode' || o_orderkey % 7 AS mode FROM orders)"
_SECTIONS = f"""WITH {_BLOCKS}, b AS (SELECT doc_id, nth, {_list(_KINDS, 'k + nth')} AS kind, mode || k % 10 AS text, k FROM b0),
heads AS (SELECT doc_id, nth, text FROM b WHERE kind = 'SECTION_HEADER' AND k % 3 <> 0), parts AS (SELECT doc_id, nth, '第貳部分 ' || text AS text FROM b WHERE kind = 'SECTION_HEADER' AND k % 3 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS section FROM heads),
rest AS (SELECT b.*, coalesce(n.section, 0) AS section FROM b ASOF LEFT JOIN numbered n ON n.doc_id = b.doc_id AND b.nth >= n.nth WHERE kind NOT IN ('HEADER_FOOTER', 'SECTION_HEADER')),
inside AS (SELECT * FROM rest WHERE kind <> 'SECTION_NOTE')"""
_UNITS = f"""WITH {_BLOCKS}, b AS (SELECT doc_id, nth, page, k, {_list(_WORK, 'k + nth')} AS kind, mode FROM b0),
heads AS (SELECT doc_id, nth AS start, page, mode AS label, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS unit, lead(nth) OVER (PARTITION BY doc_id ORDER BY nth) AS next FROM b WHERE kind = 'EXERCISE_HEADER'),
x AS (SELECT b.*, h.unit, h.next FROM b JOIN heads h ON h.doc_id = b.doc_id AND b.nth > h.start AND (h.next IS NULL OR b.nth < h.next)),
solved AS (SELECT doc_id, unit, min(nth) AS from_, max(CASE WHEN k % 2 = 1 THEN nth END) AS own FROM x WHERE kind = 'EXPLANATION' GROUP BY 1, 2),
m AS (SELECT x.doc_id, nth, kind, CASE WHEN kind = 'EXPLANATION' THEN mode ELSE mode END AS text, from_ IS NOT NULL AND nth > from_ AND next IS NOT NULL AND nth > coalesce(own, -1) AND kind IN ('STEM', 'OPTION') AS back, x.unit,
  CASE WHEN kind = 'TEACHING_NOTE' THEN 'NOTE' WHEN kind = 'EXPLANATION' AND k % 2 = 1 THEN 'EXPLANATION' WHEN kind IN ('STEM', 'OPTION') AND (from_ IS NULL OR nth < from_) THEN 'STEM' WHEN kind IN ('STEM', 'OPTION') THEN 'EXPLANATION' END AS part FROM x LEFT JOIN solved s ON s.doc_id = x.doc_id AND s.unit = x.unit),
r AS (SELECT doc_id, nth, kind, text, CASE WHEN back THEN unit + 1 ELSE unit END AS unit, CASE WHEN back THEN 'STEM' ELSE part END AS part FROM m WHERE part IS NOT NULL),
whole AS (SELECT DISTINCT doc_id, unit FROM r WHERE part = 'STEM')"""
_ORDER_AT = ", ".join(f"({k}, {z}, {c}, {p}, {'true' if top is None else 'false'})" for k, z, c, p, _, _, top, _ in _laid_out())
ORACLES = {
    "page_replace": "SELECT doc_id, page, block, CASE WHEN (doc_id + page) % 3 = 0 THEN 'second' ELSE 'first' END AS text FROM (SELECT o_custkey // 4 AS doc_id, o_orderkey // 300 AS page, o_orderkey AS block FROM orders) WHERE (doc_id + page) % 3 > 0 OR (doc_id + page) % 7 > 0",
    "rank_import_table": "SELECT c_nationkey AS class, c_custkey AS user_id, c_custkey % 100 + CASE WHEN c_nationkey % 5 = 0 THEN 1000 ELSE 0 END AS percentile FROM customer WHERE c_nationkey % 5 > 0 OR c_custkey % 2 = 0",
    "file_kinds": "SELECT o_orderkey, (['pdf', 'png', 'jpeg', 'gif', 'zip', 'webp', 'unknown', 'unknown', 'unknown'])[o_orderkey % 9 + 1] AS kind FROM orders",
    "admission_years": "SELECT o_orderkey, CAST(year(o_orderdate - INTERVAL 7 MONTHS) - 1911 AS INT) AS year FROM orders",
    "reading_order": f"""WITH o AS (SELECT o_orderkey AS page, o_orderkey % 5 AS layout, 3 + o_custkey % 5 AS lines FROM orders), lies AS (SELECT * FROM (VALUES {_ORDER_AT}) v(layout, zone, col, part, many)),
b AS (SELECT page, zone, col, part, line FROM o JOIN lies USING (layout), range(8) t(line) WHERE line < CASE WHEN many THEN lines ELSE 1 END)
SELECT page, CAST((zone * 7 + col * 5 + part * 3 + line * 11 + 100) * 1000 + zone * 100 + col * 10 + part + 1 AS INT) AS block, CAST(row_number() OVER (PARTITION BY page ORDER BY zone, col, line, part) AS INT) AS place FROM b""",
    "block_kinds_table": f"""WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS nth, {_list([k for _, _, k in BEGINNINGS], 'o_orderkey * 7 + o_custkey')} AS own FROM orders)
SELECT doc_id, nth, CASE WHEN own <> 'GOES_ON' THEN own ELSE coalesce((SELECT CASE WHEN p.own IN ('OPTION', 'STEM', 'QUESTION_NO') THEN p.own END FROM b p WHERE p.doc_id = b.doc_id AND p.nth < b.nth AND p.own NOT IN ('HEADER_FOOTER', 'GOES_ON') ORDER BY p.nth DESC LIMIT 1), 'STEM') END AS kind FROM b""",
    "page_merge": f"""WITH RECURSIVE {_BLOCKS}, b AS (SELECT doc_id, page, nth, {_list(['STEM', 'STEM', 'OPTION', 'STEM', 'HEADER_FOOTER'], 'k')} AS kind, mode || {_list(_ENDS, 'k + nth')} AS text, y0, y1, row_number() OVER (PARTITION BY doc_id ORDER BY page, nth) AS i FROM b0),
ends AS (SELECT doc_id, page, min(i) AS lo, max(i) AS hi FROM b WHERE kind <> 'HEADER_FOOTER' GROUP BY 1, 2),
f AS (SELECT b.*, coalesce(i = hi AND y1 >= 0.88, false) AS goes_on, coalesce(i = lo AND y0 <= 0.12, false) AS came FROM b LEFT JOIN ends USING (doc_id, page)),
j AS (SELECT f.*, EXISTS (SELECT 1 FROM f p WHERE p.doc_id = f.doc_id AND p.i = f.i - 1 AND p.goes_on AND f.came AND p.kind = f.kind) AS joins FROM f),
grow AS (SELECT doc_id, i AS start, i, page, kind, text, 1 AS parts FROM j WHERE NOT joins UNION ALL SELECT g.doc_id, g.start, j.i, g.page, g.kind, g.text || CASE WHEN regexp_matches(g.text, '[一-鿿　-〿]\\s*$') THEN '' ELSE ' ' END || j.text, g.parts + 1 FROM grow g JOIN j ON j.doc_id = g.doc_id AND j.i = g.i + 1 AND j.joins)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS nth, page, kind, text, parts FROM (SELECT * FROM grow QUALIFY i = max(i) OVER (PARTITION BY doc_id, start))""",
    "section_table": f"""{_SECTIONS}, counted AS (SELECT doc_id, section, count(*) AS blocks FROM inside GROUP BY 1, 2), firsts AS (SELECT doc_id, min(nth) AS nth FROM rest WHERE section = 0 GROUP BY 1),
named AS (SELECT doc_id, section, nth, text FROM numbered UNION ALL SELECT doc_id, 0, nth, '' FROM firsts)
SELECT c.doc_id, c.section, CASE WHEN p.text IS NULL THEN n.text WHEN n.section = 0 THEN p.text ELSE p.text || ' / ' || n.text END AS title, coalesce((SELECT string_agg(r.text, ' ' ORDER BY r.nth) FROM rest r WHERE r.doc_id = c.doc_id AND r.section = c.section AND r.kind = 'SECTION_NOTE'), '') AS note, c.blocks
FROM counted c JOIN (SELECT n.*, p.text AS p FROM named n ASOF LEFT JOIN parts p ON p.doc_id = n.doc_id AND n.nth >= p.nth) n USING (doc_id, section), LATERAL (SELECT n.p AS text) p""",
    "section_members": f"{_SECTIONS} SELECT doc_id, section, nth, kind FROM inside",
    "exercise_table": f"""{_UNITS} SELECT h.doc_id, h.unit, h.label, h.page, coalesce((SELECT CASE WHEN x.k % 4 = 0 THEN '(B)' ELSE x.mode END FROM x WHERE x.doc_id = h.doc_id AND x.unit = h.unit AND x.kind = 'ANSWER_KEY' ORDER BY x.nth DESC LIMIT 1), '') AS answer FROM heads h JOIN whole USING (doc_id, unit)""",
    "exercise_members": f"{_UNITS} SELECT doc_id, unit, part, CAST(row_number() OVER (PARTITION BY doc_id, unit, part ORDER BY nth) AS INT) AS place, kind, text FROM r JOIN whole USING (doc_id, unit)",
}
