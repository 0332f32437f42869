"""Blocks of pages into one text: what pages cut apart is joined, papers are split into sections, worksheets into exercises.

Everything is windows over a document's blocks in their order, so one shuffle by document serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A part of a paper, where content starts and ends on a page, kinds that go on over a page's end or start.
PART = r"^\s*第\s*[壹貳參叁肆伍陸柒捌玖拾]+\s*部分"
TOP, BOTTOM = 0.12, 0.88
ENDS_OPEN = ("STEM", "OPTION", "GROUP_LEAD", "QUESTION_NO")
STARTS_OPEN = ("OPTION", "STEM")
SKIP = "HEADER_FOOTER"

_SPACE = r"[\s\x{3000}]"


def _strip(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), f"^{_SPACE}+|{_SPACE}+$", "")


def mark_page_cuts(blocks: DataFrame, top: float = TOP, bottom: float = BOTTOM) -> DataFrame:
    """``blocks`` (doc_id, page, nth, kind, y0, y1) with ``goes_on`` (the last content block of a page reaches its foot) and ``came_from`` (the first starts at its head)."""
    w = Window.partitionBy("doc_id", "page").orderBy("nth")
    content = F.when(F.col("kind") != SKIP, F.col("nth"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = blocks.withColumn("lo", F.min(content).over(whole)).withColumn("hi", F.max(content).over(whole))
    goes_on = (F.col("nth") == F.col("hi")) & (F.col("y1") >= bottom) & F.col("kind").isin(*ENDS_OPEN)
    came_from = (F.col("nth") == F.col("lo")) & (F.col("y0") <= top) & F.col("kind").isin(*STARTS_OPEN)
    return b.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("came_from", F.coalesce(came_from, F.lit(False))).drop("lo", "hi")


def merge_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, nth, page, kind, text, parts): blocks in document order, those that a page's end cut in two joined again.

    blocks: doc_id, page, nth, kind, text, goes_on, came_from.  A block joins the one before it if that goes on, this came from there and
    both are of one kind; a space stands between them unless the text so far ends in a CJK character.  ``nth`` and ``page`` are the first part's.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "nth")
    joins = F.col("came_from") & F.lag("goes_on").over(w) & (F.col("kind") == F.lag("kind").over(w))
    b = blocks.withColumn("first", (~F.coalesce(joins, F.lit(False))).cast("int"))
    b = b.withColumn("unit", F.sum("first").over(w))
    parts = F.array_sort(F.collect_list(F.struct("page", "nth", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    joined = lambda so, x: F.concat(so, F.when(so.rlike(f"[\\x{{4E00}}-\\x{{9FFF}}\\x{{3000}}-\\x{{303F}}]{_SPACE}*$"), "").otherwise(" "), x["text"])
    g = b.groupBy("doc_id", "unit").agg(parts.alias("p"))
    text = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0]["text"], joined)
    return g.select("doc_id", F.col("unit").cast("long").alias("nth"), F.col("p")[0]["page"].alias("page"), F.col("p")[0]["kind"].alias("kind"), text.alias("text"), F.size("p").alias("parts"))


def split_sections(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, members): doc_id, section, title, note, blocks; and doc_id, section, nth, kind, text.

    blocks: doc_id, nth, kind, text.  A section header starts a section; a part's header starts none but stands in front of the titles that
    follow.  What comes before the first header is section 0 under the part so far.  Notes are gathered, heads and feet left out, sections without blocks too.
    """
    w = Window.partitionBy("doc_id").orderBy("nth")
    b = blocks.where(F.col("kind") != SKIP).withColumn("text", F.coalesce("text", F.lit("")))
    header, part = F.col("kind") == "SECTION_HEADER", F.col("text").rlike(PART)
    b = b.withColumn("part", F.coalesce(F.last(F.when(header & part, _strip("text")), ignorenulls=True).over(w), F.lit("")))
    b = b.where(~(header & part)).withColumn("section", F.sum(header.cast("long")).over(w))
    head = F.when(F.col("part") != "", F.concat("part", F.lit(" / "), _strip("text"))).otherwise(_strip("text"))
    title = F.min_by(F.when(F.col("section") > 0, head).otherwise(F.col("part")), "nth")
    notes = F.array_sort(F.collect_list(F.when(F.col("kind") == "SECTION_NOTE", F.struct("nth", "text"))))
    inside = ~header & (F.col("kind") != "SECTION_NOTE")
    s = b.groupBy("doc_id", "section").agg(title.alias("title"), F.trim(F.array_join(F.transform(notes, lambda x: x["text"]), " ")).alias("note"), F.count(F.when(inside, 1)).alias("blocks"))
    return s.where("blocks > 0"), b.where(inside).select("doc_id", "section", "nth", "kind", "text")


def split_exercises(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, members): doc_id, unit, label, page, answer; and doc_id, unit, part (STEM, EXPLANATION or NOTE), place, kind, text.

    blocks: doc_id, nth, page, kind, text and answers (array, printed in the key's ink).  An exercise header starts a unit; from its solution on blocks are
    explanation.  Blocks after the last of a solution's own blocks belong to the exercise after it when there is one: the header's label stands
    beside the second line of its text, so the first was read before it.  Units without a stem are left out, and what comes before the first header.
    """
    w = Window.partitionBy("doc_id").orderBy("nth")
    b = blocks.where(F.col("kind") != SKIP).withColumn("text", F.coalesce("text", F.lit("")))
    header = F.col("kind") == "EXERCISE_HEADER"
    b = b.withColumn("unit", F.sum(header.cast("long")).over(w)).where("unit > 0")
    unit = Window.partitionBy("doc_id", "unit").orderBy("nth")
    solution = F.col("kind") == "EXPLANATION"
    body = _strip_body()
    b = b.withColumn("solving", F.coalesce(F.max(F.when(solution, True)).over(unit), F.lit(False)))
    b = b.withColumn("body", F.when(solution, body)).withColumn("units", F.max("unit").over(Window.partitionBy("doc_id")))
    own = F.when(solution & (F.col("body") != ""), F.col("nth"))
    b = b.withColumn("last_own", F.max(own).over(unit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    plain = ~header & ~F.col("kind").isin("EXPLANATION", "ANSWER_KEY", "TEACHING_NOTE")
    back = plain & F.col("solving") & (F.col("unit") < F.col("units")) & (F.col("nth") > F.coalesce("last_own", F.lit(-1)))
    part = F.when(F.col("kind") == "TEACHING_NOTE", "NOTE").when(solution & (F.col("body") != ""), "EXPLANATION").when(plain & (back | ~F.col("solving")), "STEM").when(plain, "EXPLANATION")
    m = b.withColumn("part", part).withColumn("unit_", F.when(back, F.col("unit") + 1).otherwise(F.col("unit")))
    m = m.where("part is not null").select("doc_id", F.col("unit_").alias("unit"), "part", "nth", "kind", F.coalesce("body", "text").alias("text"))
    place = F.row_number().over(Window.partitionBy("doc_id", "unit", "part").orderBy("nth"))
    m = m.withColumn("place", place).drop("nth")
    printed = F.when(F.size(F.coalesce("answers", F.array().cast("array<string>"))) > 0, F.array_join("answers", " ")).otherwise(F.col("text"))
    answer = F.regexp_replace(F.regexp_replace(printed, r"^\s*答\s*[：:]\s*|[\s\x{3000}。]+$", ""), f"^{_SPACE}+|{_SPACE}+$", "")
    key = F.max_by(F.when(F.col("kind") == "ANSWER_KEY", answer), F.when(F.col("kind") == "ANSWER_KEY", F.col("nth")))
    units = b.groupBy("doc_id", "unit").agg(F.max(F.when(header, _strip("text"))).alias("label"), F.max(F.when(header, F.col("page"))).alias("page"), F.coalesce(key, F.lit("")).alias("answer"))
    full = m.where("part = 'STEM'").select("doc_id", "unit").distinct()
    return units.join(full, ["doc_id", "unit"], "left_semi"), m.join(full, ["doc_id", "unit"], "left_semi")


def _strip_body() -> Column:
    """A solution block without the mark it starts with."""
    return F.regexp_replace(F.regexp_replace("text", r"^[\s\x{3000}]*解[\s\x{3000}]*[：:]?[\s\x{3000}]*$|^[\s\x{3000}]*解[\s\x{3000}]+", ""), f"^{_SPACE}+|{_SPACE}+$", "")
