"""Pages into documents: kinds of blocks, ids and references over pages, assets and figures in their places, reading order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from . import graph

_D = "0-9０-９"
_NUMBER = rf"[{_D}]{{1,3}}\s*(?:[.．](?![0-9])|[、·])"
#: Kinds of blocks and how they look, in this order; the first that fits counts.
KINDS = [
    ("EXERCISE_HEADER", rf"^(?:範例|類題|例題|習題|隨堂練習|練習題|綜合練習|自我評量|精選題)\s*[{_D}]{{0,3}}$"),
    ("ANSWER_KEY", r"^答\s*[：:]"),
    ("EXPLANATION", r"^解\s*[：:]?$|^解\s+"),
    ("HEADER_FOOTER", r"^[◎★☆●※]\s*搭配"),
    ("SECTION_NOTE", rf"^說\s*明\s*[：:].*(?:第\s*[{_D}]+\s*題|[{_D}]+\s*分|選項|作答|答案[卡欄區])"),
    ("TEACHING_NOTE", r"^(?:說\s*明|註|提示|想法|作法|觀念|補充|延伸)\s*[：:]"),
    ("CONCEPT", rf"^[{_D}]{{1,2}}\s*[.、．]\s*\S{{1,20}}\s*[：:]$"),
    ("EXPLANATION", r"^[【\[]?\s*(?:詳解|解析|答案與解析|說明與解析|試題解析)"),
    ("HEADER_FOOTER", rf"^(?:[-－]?\s*[{_D}]+\s*[-－]?$|第\s*[{_D}]+\s*頁|共\s*[{_D}]+\s*頁|[{_D}]+\s*學年度)"),
    ("GROUP_LEAD", rf"第?\s*[{_D}]+\s*題?\s*(?:至|[-－—~～])\s*第?\s*[{_D}]+\s*題?\s*為題組"),
    ("GROUP_LEAD", rf"請\s*(?:問|回?答|依據.{{0,12}}回答)\s*第?\s*[{_D}]+\s*題?\s*[至~～\-－—]\s*第?\s*[{_D}]+\s*題"),
    ("GROUP_LEAD", rf"回答\s*(?:下列|以下)?\s*第?\s*[{_D}]+\s*[.．]?\s*[至~～\-－—]\s*第?\s*[{_D}]+\s*[.．]?\s*題"),
    ("SECTION_HEADER", rf"^(?:[一二三四五六七八九十]+\s*[、．.]|第\s*(?:[壹貳參叁肆伍陸柒捌玖拾一二三四五六七八九十]+|[{_D}]+)\s*部分)"),
    ("SECTION_HEADER", rf"^[{_D}]?\s*(?:考古題[大搜查練]*|夯時事[練習]*\S{{0,4}}|好好[練做]題|綜合演練|實力養成|牛刀小試|即時練習|學測.{{0,4}}演練|歷屆試題|試題演練|能力檢測|文法選擇|字彙測驗|閱讀測驗|克漏字[測驗]*|翻譯練習)\s*(?:[：:].*)?$"),
    ("ANSWER_AREA", r"^(?:作答[區欄格]|答案[區欄格]|請於下方作答)$"),
    ("ANSWER_AREA", rf"(?:[{_D}]+\s*[.、．]\s*[（(]?[{_D}A-E]+[）)]?[\s,，]*){{3,}}"),
    ("STEM", r"^[(（]\s*[a-zａ-ｚ]\s*[)）]"),
    ("QUESTION_NO", rf"^[(（](?:\s+[A-EＡ-Ｅ①-⑩{_D}]\s+|\s*)[)）]\s*{_NUMBER}"),
    ("OPTION", rf"^[(（]\s*[{_D}A-EＡ-Ｅ]\s*[)）]|^[①②③④⑤⑥⑦⑧⑨⑩]|^[ＡＢＣＤＥ][、．.]"),
    ("QUESTION_NO", rf"^(?:[(（]\s*[{_D}]{{1,3}}\s*[)）]|{_NUMBER})\s*\S"),
]
GOES_ON = ("OPTION", "STEM", "QUESTION_NO")


def block_kinds(blocks: DataFrame, key: str = "doc_id", order: str = "nth") -> DataFrame:
    """``blocks`` (key, order, text) with ``kind``: by how a block looks, else as the one before goes on (heads and feet aside), else STEM.

    White space is Unicode's; a null or blank text is a head or foot.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    own = F.when(text == "", "HEADER_FOOTER")
    for kind, pattern in KINDS:
        own = own.when(text.rlike("(?U)" + pattern), kind)
    before = F.last(F.when(F.col("own") != "HEADER_FOOTER", F.col("own")), ignorenulls=True).over(Window.partitionBy(key).orderBy(order))
    b = blocks.withColumn("own", own)
    return b.withColumn("kind", F.coalesce("own", F.when(before.isin(*GOES_ON), before).otherwise("STEM"))).drop("own")


def page_ids(parts: DataFrame) -> DataFrame:
    """``parts`` (doc_id, page, kind, raw) with ``id``: page and kind in front of what was read, as every page numbers from 1 again."""
    clean = F.substring(F.regexp_replace("raw", "[^A-Za-z0-9_-]", ""), 1, 12)
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.substring("kind", 1, 1), F.when(clean == "", "x").otherwise(clean))
    return parts.withColumn("id", F.substring(name, 1, 32))


def resolve(references: DataFrame, parts: DataFrame, kinds: list[str], keep: bool = False) -> DataFrame:
    """``references`` (doc_id, page, raw) with ``id`` of what they name on their page; of several kinds of one name the last in ``kinds``.

    What is not there is null, or stays as it was read with ``keep``.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    known = page_ids(parts).groupBy("doc_id", "page", "raw").agg(F.max_by("id", F.struct(rank, "id")).alias("id"))
    j = references.join(known, ["doc_id", "page", "raw"], "left")
    return j.withColumn("id", F.coalesce("id", "raw")) if keep else j


_ASSET = r"!\[\[a:([^\]\s]+)\]\]"


def assets_in_place(texts: DataFrame, assets: DataFrame) -> DataFrame:
    """question_id, place, seq, asset: each asset beside the texts that name it, in the order of the names; unnamed ones go to the stem; named ones that are not there have no ``seq``.

    texts: question_id, place (STIMULUS, STEM or an option), text; assets: question_id, nth, asset.  Names and assets are dealt to
    their questions once, and meet there by sorting.
    """
    names = F.posexplode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_ASSET), F.lit(1)))).alias("at", "asset")
    named = texts.select("question_id", "place", names).select("question_id", "asset", F.lit(True).alias("named"), "place", F.col("at").cast("long").alias("order"))
    there = assets.select("question_id", "asset", F.lit(False).alias("named"), F.lit("STEM").alias("place"), (F.col("nth") + 1_000_000).cast("long").alias("order"))
    one, known = Window.partitionBy("question_id", "asset"), F.col("question_id").isNotNull()
    rows = named.unionByName(there).repartition("question_id").withColumn("n", F.row_number().over(one.orderBy("named", F.asc_nulls_last("order"))))
    rows = rows.withColumn("missing", F.col("named") & ~(known & F.bool_or(~F.col("named")).over(one))).withColumn("free", ~(known & F.bool_or("named").over(one)))
    rows = rows.where(F.col("named") | (F.col("free") & (F.col("n") == 1)))
    seq = F.when(~F.col("missing"), F.row_number().over(Window.partitionBy("question_id", "place", "missing").orderBy("order")))
    return rows.select("question_id", "place", seq.alias("seq"), "asset")


def placed_assets(texts: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, missing) of ``assets_in_place``: question_id, place, seq, asset and question_id, place, asset."""
    rows = assets_in_place(texts, assets)
    return rows.where("seq is not null"), rows.where("seq is null").drop("seq")


def _touching(strokes: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """(strokes with ``node``, links of nodes) for figures: boxes that meet have the same or linked nodes, others have not.

    Boxes are widened by half of ``gap`` and seen on a lattice that is finer than ``gap``, so each holds a lattice point, and all that hold one
    point meet there: the point stands for them under its least stroke.  Two boxes that meet without a common point hold two corners of one
    cell.  Corners side by side are linked if the boxes that reach farthest from both meet; for opposite ones only boxes that end in
    the cell are new, and a running maximum over their corners tells whether any two meet.  So links grow with strokes and lattice points, never with pairs.
    Lattice points meet by sorting: in Parquet they look small enough to broadcast, but they grow with pages.
    """
    cell, half = F.lit(gap * 0.75), gap / 2
    low, high = lambda c: (F.floor((F.col(c) - half) / cell) + 1), lambda c: (F.ceil((F.col(c) + half) / cell) - 1)
    s = strokes.where("x0 <= x1 and y0 <= y1").withColumns({"i0": low("x0"), "j0": low("y0"), "i1": high("x1"), "j1": high("y1")})
    held = s.select("page", "stroke", "x0", "y0", "x1", "y1", "j0", "j1", F.explode(F.sequence("i0", "i1")).alias("i")).withColumn("j", F.explode(F.sequence("j0", "j1")))
    nodes = stored(held.groupBy("page", "i", "j").agg(F.min("stroke").alias("node"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")), "nodes")
    points = nodes.select("page", "i", "j", "node")
    ahead = lambda di, dj: nodes.select("page", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("node").alias("dst"), F.col("x0").alias("bx0"), F.col("y0").alias("by0")).hint("merge")
    links = [nodes.join(ahead(1, 0), ["page", "i", "j"]).where(F.col("x1") + gap > F.col("bx0")), nodes.join(ahead(0, 1), ["page", "i", "j"]).where(F.col("y1") + gap > F.col("by0"))]
    links = [x.select(F.col("node").alias("src"), "dst") for x in links]
    for up in (True, False):
        # in the cell of lower left corner (i, j): ends there (one side), or starts there (the other); mirrored in y for the falling diagonal
        i_from, i_to = F.col("i1"), F.col("i0") - 1
        j_from, j_to = (F.col("j1"), F.col("j0") - 1) if up else (F.col("j0") - 1, F.col("j1"))
        y_from, y_to = (F.col("y1"), F.col("y0")) if up else (-F.col("y0"), -F.col("y1"))
        ends = s.groupBy("page", i_from.alias("i"), j_from.alias("j"), (F.col("x1") + gap).alias("x")).agg(F.max(y_from + gap).alias("y")).withColumn("side", F.lit(1))
        starts = s.groupBy("page", i_to.alias("i"), j_to.alias("j"), F.col("x0").alias("x")).agg(F.min(y_to).alias("y")).withColumn("side", F.lit(0))
        before = Window.partitionBy("page", "i", "j").orderBy(F.desc("x"), "side").rowsBetween(Window.unboundedPreceding, 0)
        reach = F.max(F.when(F.col("side") == 1, F.col("y"))).over(before)
        met = ends.unionByName(starts).withColumn("reach", reach).where("side = 0 and reach > y").select("page", "i", "j").distinct()
        first, second = (0, 1) if up else (1, 0)  # rows of the corners on the left and on the right
        left = points.select("page", "i", (F.col("j") - first).alias("j"), F.col("node").alias("src"))
        right = points.select("page", (F.col("i") - 1).alias("i"), (F.col("j") - second).alias("j"), F.col("node").alias("dst"))
        links.append(met.join(left.hint("merge"), ["page", "i", "j"]).join(right.hint("merge"), ["page", "i", "j"]).select("src", "dst"))
    home = points.withColumnsRenamed({"i": "i0", "j": "j0"})
    return s.join(home.hint("merge"), ["page", "i0", "j0"]), functools.reduce(DataFrame.unionAll, links).where("src <> dst").distinct()


def _pairs(strokes: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """The same as ``_touching`` without a lattice: pairs of boxes within cells of a grid that both touch."""
    cell = F.lit(64.0)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    b = strokes.withColumn("cx", span(F.col("x0"), F.col("x1"))).withColumn("cy", span(F.col("y0"), F.col("y1")))
    a = b.select("page", "cx", "cy", F.col("stroke").alias("src"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    meet = f"src <> stroke and a_x0 - {gap} < x1 and a_x1 + {gap} > x0 and a_y0 - {gap} < y1 and a_y1 + {gap} > y0"
    return strokes.withColumn("node", F.col("stroke")), a.join(b.hint("merge"), ["page", "cx", "cy"]).where(meet).select("src", F.col("stroke").alias("dst")).distinct()


def figures(strokes: DataFrame, gap: float = 9.0, least: int = 4, size: float = 28.0) -> DataFrame:
    """Figures on pages: strokes whose boxes, ``gap`` wider, meet are one figure, of ``least`` strokes and ``size`` a side or more.

    strokes: page, stroke (long, unique), x0, y0, x1, y1 (x0 <= x1, y0 <= y1).  A figure's number is its least stroke.  With a gap above 0
    pages may hold any number of strokes; otherwise no lattice is finer than every box, and pairs are compared.
    """
    s, links = _touching(strokes, gap) if gap > 0 else _pairs(strokes, gap)
    comp = graph.components(links)
    total = {"strokes": F.sum, "x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    box = s.groupBy("page", "node").agg(F.count("*").alias("strokes"), *[f(c).alias(c) for c, f in total.items() if c != "strokes"])
    box = box.join(comp.hint("merge"), "node", "left").groupBy("page", F.coalesce("component", "node").alias("figure")).agg(*[f(c).alias(c) for c, f in total.items()])
    return box.where((F.col("strokes") >= least) & (F.col("x1") - F.col("x0") >= size) & (F.col("y1") - F.col("y0") >= size))


def canonical_order(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``items`` (page, x, y, item) with ``place`` in their document: by page, then top to bottom and left to right, to a thousandth."""
    r = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 3)
    return items.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("page", r("y"), r("x"), "item")))


def bank_rows(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """What a commit does with a job's candidates: (job_id, candidate_id, action) with COMMIT, DUPLICATE, REJECTED or WAITING.

    Confirmed candidates are committed once by content hash (the first of a job, none that the bank has), rejected ones are
    left out and others wait.  candidates: job_id, candidate_id, state, hash; existing: hash.
    """
    confirmed = F.col("state") == "CONFIRMED"
    first = candidates.where(confirmed).groupBy("job_id", "hash").agg(F.min("candidate_id").alias("first"))
    j = candidates.join(first, ["job_id", "hash"], "left").join(existing.select("hash", F.lit(True).alias("known")).distinct(), "hash", "left")
    again = F.col("known").isNotNull() | (F.col("candidate_id") != F.col("first"))
    return j.select("job_id", "candidate_id", F.when(F.col("state") == "REJECTED", "REJECTED").when(~confirmed, "WAITING").when(again, "DUPLICATE").otherwise("COMMIT").alias("action"))
