"""Checks of extracted documents, rubrics, picks and answers: one row for each thing that is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DOCUMENT = """doc_id long,
questions array<struct<id:string,kind:string,stem:string,options:array<struct<label:string,content:string>>,group_id:string,section_id:string,asset_ids:array<string>,unit_canonical:string,custom_type:struct<name:string,confirmed:boolean>>>,
groups array<struct<id:string,section_id:string,stimulus:string>>, sections array<struct<id:string>>, assets array<struct<id:string>>, materials array<struct<id:string,body:string,asset_ids:array<string>>>"""
#: Fixed value: how a text refers to an asset.
REFERENCE = r"!\[\[a:([^\]]+)\]\]"


def _ids(collection: str) -> Column:
    return F.transform(F.coalesce(collection, F.expr("array()")), lambda x: x["id"])


def _refs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(1))


def _issue(code: str, ref: Column, cond: Column) -> Column:
    return F.when(cond, F.struct(F.lit(code).alias("code"), ref.alias("ref")))


def _text_issues(ref: Column, text: Column, assets: Column) -> list[Column]:
    """Odd dollars, unbalanced braces, references to assets that the document does not have."""
    t = F.coalesce(text, F.lit(""))
    dollars = F.regexp_count(t, F.lit(r"(?<!\\)\$")) % 2 == 1
    braces = F.regexp_count(t, F.lit(r"(?<!\\)\{")) != F.regexp_count(t, F.lit(r"(?<!\\)\}"))
    return [_issue("content_markup", ref, dollars | braces), _issue("dangling_asset", ref, F.size(F.array_except(_refs(t), assets)) > 0)]


def _missing(wanted: Column, have: Column) -> Column:
    return wanted.isNotNull() & ~F.coalesce(F.array_contains(have, wanted), F.lit(False))


def validate_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, code, ref) for documents of the shape DOCUMENT; null collections count as empty.

    A document's parts are checked within its row, so nothing is shuffled.
    """
    assets, groups, sections = F.array_compact(_ids("assets")), F.array_compact(_ids("groups")), F.array_compact(_ids("sections"))

    def question(q: Column) -> Column:
        listed = F.coalesce(q["asset_ids"], F.expr("cast(array() as array<string>)"))
        options = F.coalesce(q["options"], F.expr("cast(array() as array<struct<label:string,content:string>>)"))
        texts = F.transform(options, lambda o: F.lower(F.trim(F.regexp_replace(F.coalesce(o["content"], F.lit("")), r"\s+", " "))))
        filled = F.filter(texts, lambda t: t != "")
        used = F.array_union(_refs(q["stem"]), F.flatten(F.transform(options, lambda o: _refs(o["content"]))))
        return F.array(
            _issue("dangling_group", q["id"], _missing(q["group_id"], groups)), _issue("dangling_section", q["id"], _missing(q["section_id"], sections)),
            _issue("dangling_asset", q["id"], F.size(F.array_except(listed, assets)) > 0), _issue("asset_not_listed", q["id"], F.size(F.array_except(used, listed)) > 0),
            _issue("empty_option", q["id"], (F.size(options) > 1) & (F.size(filled) < F.size(options))), _issue("duplicate_options", q["id"], (F.size(options) > 1) & (F.size(F.array_distinct(filled)) < F.size(filled))),
            _issue("unit_unparsed", q["id"], F.coalesce(F.startswith(q["unit_canonical"], F.lit("?")), F.lit(False))),
            _issue("custom_type_missing", q["id"], (q["kind"] == "PUBLISHER_CUSTOM") & q["custom_type"].isNull()), _issue("custom_type_unconfirmed", q["id"], (q["kind"] == "PUBLISHER_CUSTOM") & ~F.coalesce(q["custom_type"]["confirmed"], F.lit(True))),
            *_text_issues(q["id"], F.concat_ws("\n", q["stem"], F.transform(options, lambda o: o["content"])), assets),
        )

    used_groups = F.transform(F.coalesce("questions", F.expr("array()")), lambda q: q["group_id"])
    per = {
        "questions": question,
        "groups": lambda g: F.array(_issue("dangling_section", g["id"], _missing(g["section_id"], sections)), _issue("orphan_group", g["id"], ~F.coalesce(F.array_contains(F.array_compact(used_groups), g["id"]), F.lit(False))), *_text_issues(g["id"], g["stimulus"], assets)),
        "materials": lambda m: F.array(_issue("dangling_asset", m["id"], F.size(F.array_except(F.coalesce(m["asset_ids"], F.expr("cast(array() as array<string>)")), assets)) > 0), *_text_issues(m["id"], m["body"], assets)),
    }
    found = [F.flatten(F.transform(F.coalesce(c, F.expr("array()")), f)) for c, f in per.items()]
    for c in ("questions", "groups", "sections", "assets", "materials"):
        found.append(F.transform(_twice(F.array_compact(_ids(c))), lambda i: F.struct(F.lit("duplicate_id").alias("code"), i.alias("ref"))))
    issues = F.array_distinct(F.array_compact(F.concat(*found)))
    return docs.select("doc_id", F.explode(issues).alias("i")).select("doc_id", "i.code", "i.ref")


def _twice(ids: Column) -> Column:
    """The values that an array holds more than once."""
    ordered = F.array_sort(ids)
    return F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (F.try_element_at(ordered, F.when(i > 0, i).otherwise(1)) == x)))


def rubric_gaps(bands: DataFrame, key: str, most: str) -> DataFrame:
    """(key, code): bands (low, high) that leave a gap, overlap, do not start at 0 or do not reach the most."""
    w = Window.partitionBy(key).orderBy("low", "high")
    b = bands.withColumn("before", F.lag("high").over(w))
    g = b.groupBy(key).agg(
        F.bool_or(F.col("low") > F.col("before") + 1).alias("GAP"), F.bool_or(F.col("low") <= F.col("before")).alias("OVERLAP"), (F.min("low") != 0).alias("START"), (F.max("high") != F.max(most)).alias("END"), F.bool_or(F.col("low") > F.col("high")).alias("REVERSED"),
    )
    codes = ["GAP", "OVERLAP", "START", "END", "REVERSED"]
    return g.select(key, F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in codes]))).alias("code"))


def picks_fault(picks: Column) -> Column:
    """Why an array<struct<kp, weight>> of knowledge points is refused: TOO_MANY (over three), REPEATED, or WEIGHTS that do not add up to 1 within 0.02."""
    total = F.aggregate(picks, F.lit(0.0), lambda a, p: a + p["weight"])
    names = F.transform(picks, lambda p: p["kp"])
    return F.when(F.size(picks) > 3, "TOO_MANY").when(F.size(F.array_distinct(names)) < F.size(names), "REPEATED").when(F.abs(total - 1) > 0.02 + 1e-9, "WEIGHTS")


def adjusted_confidence(confidence: Column, consistency: Column) -> Column:
    """Full agreement adds 0.1, partial (0.6 or more) takes 0.1, less caps at 0.3; unknown leaves it as it is."""
    c = F.when(consistency >= 1, confidence + 0.1).when(consistency >= 0.6, confidence - 0.1).when(consistency.isNotNull(), F.least(confidence, F.lit(0.3))).otherwise(confidence)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


#: How a stem points to a figure or table, and a row of a written table.
_ENDS = r"(?=[\s、，。：；）)\]】]|$|所|中|之|的|可|為|列|資料|數據)"
FIGURE = rf"(?:如|依|由|見|參[考見]|據|根據)[右左上下本該]?[圖表]|[右左上下附]圖|圖中|(?:[右左上下附]表|[圖表]\s*[一二三四五六七八九十0-9]+){_ENDS}"
TABLE_ROW = r"(?m)^\s*\|.*\|\s*$"


def question_faults(questions: DataFrame, groups: DataFrame, explained: DataFrame) -> DataFrame:
    """(doc_id, code, ref): figures that are spoken of but not there, printed answers of another number than the paper asks for, and unexplained odd types.

    questions: doc_id, id, kind, stem, asset_ids, group_id, expected_count, answer_source, answer_keys; groups: doc_id, id, stimulus; explained: doc_id,
    question_id of questions whose content is already said to be unsupported.  An asset of the group's text counts for its questions, a
    written table stands for a figure.
    """
    g = groups.select("doc_id", F.col("id").alias("group_id"), (F.size(_refs(F.col("stimulus"))) > 0).alias("_shown")).groupBy("doc_id", "group_id").agg(F.bool_or("_shown").alias("_shown"))
    e = explained.select("doc_id", F.col("question_id").alias("id"), F.lit(True).alias("_said")).distinct()
    q = questions.join(g, ["doc_id", "group_id"], "left").join(e, ["doc_id", "id"], "left")
    stem = F.coalesce("stem", F.lit(""))
    bare = (F.coalesce(F.size("asset_ids"), F.lit(0)) < 1) & ~F.coalesce("_shown", F.lit(False)) & ~stem.rlike(TABLE_ROW)
    keys = F.coalesce(F.size("answer_keys"), F.lit(0))
    issues = [
        _issue("figure_missing", F.col("id"), bare & stem.rlike(FIGURE)),
        _issue("answer_count_mismatch", F.col("id"), (F.col("expected_count") > 0) & (F.col("answer_source") == "PRINTED") & (keys > 0) & (keys != F.col("expected_count"))),
        _issue("other_without_issue", F.col("id"), (F.col("kind") == "OTHER") & F.col("_said").isNull()),
    ]
    return q.select("doc_id", F.explode(F.array_compact(F.array(*issues))).alias("i")).select("doc_id", "i.code", "i.ref")
