"""Reading order, joined pages, sections and exercises against plain versions on random pages and on stated ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import layout as L
from gradelake.operators import reading as R
from gradelake.operators import segments as S


def by_lines(boxes):
    lines = []
    for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
        if lines:
            top, bottom = min(x[2] for x in lines[-1]), max(x[4] for x in lines[-1])
            least = min(b[4] - b[2], bottom - top)
            if least > 0 and min(b[4], bottom) - max(b[2], top) >= 0.5 * least:
                lines[-1].append(b)
                continue
        lines.append([b])
    return [b for line in lines for b in sorted(line, key=lambda b: (b[1], b[2], b[0]))]


def plain(boxes, depth=0):
    """Boxes (block, x0, y0, x1, y1) in reading order, crossings counted anew at every position."""
    scale = boxes
    if depth and boxes:
        lo, hi = min(b[1] for b in boxes), max(b[3] for b in boxes)
        if hi <= lo:
            return by_lines(boxes)
        scale = [(b[0], (b[1] - lo) / (hi - lo), b[2], (b[3] - lo) / (hi - lo), b[4]) for b in boxes]
    if depth >= 3 or len(boxes) < 4:
        return by_lines(boxes)
    at = [0.25 + i * 0.005 for i in range(101)]
    crossed = [sum(b[1] < x < b[3] for b in scale) for x in at]
    if min(crossed) > max(2, round(len(boxes) * 0.2)):
        return by_lines(boxes)
    best, i = (0, 0), 0
    while i < 101:
        j = i
        while j < 101 and crossed[j] == min(crossed):
            j += 1
        if j - i > best[1]:
            best = (i, j - i)
        i = max(j, i + 1)
    if best[1] < 6:
        return by_lines(boxes)
    cut = at[best[0]] + (best[1] - 1) * 0.005 / 2
    sides = [[boxes[k] for k, b in enumerate(scale) if test(b)] for test in (lambda b: b[3] <= cut, lambda b: b[1] >= cut, lambda b: b[1] < cut < b[3])]
    left, right, over = sides
    if len(left) < 2 or len(right) < 2 or (len(left) + len(right)) / len(boxes) < 0.8:
        return by_lines(boxes)
    first = min(b[2] for b in left + right)
    return by_lines([b for b in over if b[4] <= first]) + plain(left, depth + 1) + plain(right, depth + 1) + by_lines([b for b in over if b[4] > first])


def pages(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        columns = r.choice([[(0, 1)], [(0, 0.46), (0.54, 1)], [(0, 0.6), (0.67, 1)], [(0, 0.3), (0.36, 0.62), (0.7, 1)]])
        boxes = [(k, a + r.random() * 0.02, y + r.random() * 0.02, b - r.random() * 0.05, y + 0.02 + r.random() * 0.05) for a, b in columns for k, y in enumerate(np.linspace(0.1, 0.9, r.randint(2, 9)).tolist())]
        boxes += [(0, 0.05, r.choice([0.01, 0.5, 0.95]), 0.95, r.choice([0.02, 0.55, 0.99])) for _ in range(r.randint(0, 2))]
        boxes += [(0, *sorted([r.random(), r.random()]), r.random(), r.random()) for _ in range(r.randint(0, 2))]
        boxes = [(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)) for _, x0, y0, x1, y1 in boxes]
        r.shuffle(boxes)
        yield [(k, *b) for k, b in enumerate(boxes)]


def test_reading_order_of_random_pages(spark):
    made = dict(enumerate(pages(1, 300)))
    made[300], made[301] = [(0, 0.5, 0.1, 0.5, 0.2)] * 1, [(k, 0.3, 0.1 * k, 0.3, 0.1 * k) for k in range(6)]
    rows = [(p, *b, "x") for p, boxes in made.items() for b in boxes]
    df = spark.createDataFrame(rows, "page int, block int, x0 double, y0 double, x1 double, y1 double, place string").repartition(4)
    got = {}
    for r in R.reading_order(df).collect():
        got.setdefault(r.page, []).append((r.place, r.block))
    assert {p: [b for _, b in sorted(v)] for p, v in got.items()} == {p: [b[0] for b in plain(boxes)] for p, boxes in made.items()}


def test_a_title_does_not_hide_a_gutter(spark):
    rows = [(1, 0.05, 0.02, 0.95, 0.06)] + [(10 * c + r, 0.05 + 0.5 * (c - 1), 0.2 + 0.2 * r, 0.45 + 0.5 * (c - 1), 0.3 + 0.2 * r) for c in (1, 2) for r in range(3)]
    df = spark.createDataFrame([("p", *r) for r in rows], "page string, block int, x0 double, y0 double, x1 double, y1 double")
    assert [r.block for r in R.reading_order(df).orderBy("place").collect()] == [1, 10, 11, 12, 20, 21, 22]
    assert R.reading_order(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1, None, None, None, None), (None, 2, 0.1, None, 0.2, None)], df.schema)
    assert [r.block for r in R.reading_order(odd).orderBy("place").collect()] == [1, 2]


KINDS = [
    ("範例 3 求 x 的值", "STEM"), ("範例 3", "EXERCISE_HEADER"), ("（12） 下列", "QUESTION_NO"), ("(3) 甲", "OPTION"), ("1. 點斜式：", "CONCEPT"), ("第壹部分、選擇題", "SECTION_HEADER"), ("說明： 如右圖，設 P", "TEACHING_NOTE"), ("說明：第1題至第6題", "SECTION_NOTE"),
    ("- 7 -", "HEADER_FOOTER"), ("請回答 9～10 題", "GROUP_LEAD"), ("試回答下列 3.～5. 題：", "GROUP_LEAD"), ("好好練題", "SECTION_HEADER"), ("1.(3) 2.(5) 3.(1)", "ANSWER_AREA"), ("(C) 4.5 公尺", "OPTION"), ("( C ) 7. To win", "QUESTION_NO"), ("(  ) 6. It was", "QUESTION_NO"),
    ("4.5 公尺", "STEM"), ("　解　", "EXPLANATION"), ("答：　(B)", "ANSWER_KEY"), ("Ａ、甲", "OPTION"), ("作答區", "ANSWER_AREA"), (None, "HEADER_FOOTER"),
]


def test_kinds_of_blocks(spark):
    df = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(KINDS)], "doc_id int, nth int, text string")
    assert {r.doc_id: r.kind for r in L.block_kinds(df).collect()} == {i: k for i, (_, k) in enumerate(KINDS)}
    go = spark.createDataFrame([(1, i, t) for i, t in enumerate(["(A) one", "第 3 頁", "goes on", "解 x", "then", "more"])], "doc_id int, nth int, text string")
    assert [r.kind for r in L.block_kinds(go).orderBy("nth").collect()] == ["OPTION", "HEADER_FOOTER", "OPTION", "EXPLANATION", "STEM", "STEM"]


def cjk_end(t):
    c = t.rstrip()[-1:]
    return bool(c) and ("一" <= c <= "鿿" or "　" <= c <= "〿")


def papers(seed, n, kinds):
    r = random.Random(seed)
    words = ["甲", "word", "第壹部分 甲", "解", "解 body", "答： x 。", "答：", "  ", "丙。 "]
    for d in range(n):
        yield d, [(i, i // 5, r.choice(kinds), r.choice(words), r.random() < 0.5, r.random() < 0.5, r.choice([None, [], ["(B)"], ["1", "2"]])) for i in range(r.randint(0, 30))]


SCHEMA = "doc_id int, nth int, page int, kind string, text string, goes_on boolean, came_from boolean, answers array<string>"


def frame(spark, docs):
    return spark.createDataFrame([(d, *b) for d, blocks in docs for b in blocks], SCHEMA).repartition(4)


def test_pages_joined(spark):
    docs = list(papers(1, 60, ["STEM", "STEM", "OPTION"]))
    want = []
    for d, blocks in docs:
        out = []
        for _, page, kind, text, goes_on, came, _ in blocks:
            if came and out and out[-1][3] and out[-1][1] == kind:
                out[-1][2] += ("" if cjk_end(out[-1][2]) else " ") + text
                out[-1][3] = goes_on
                out[-1][4] += 1
            else:
                out.append([page, kind, text, goes_on, 1])
        want += [(d, i + 1, x[0], x[1], x[2], x[4]) for i, x in enumerate(out)]
    assert sorted(tuple(r) for r in S.merge_pages(frame(spark, docs)).collect()) == sorted(want)
    assert S.merge_pages(frame(spark, docs).limit(0)).count() == 0


def test_page_cuts(spark):
    rows = [(1, 1, 1, "STEM", 0.5, 0.9), (1, 1, 2, "HEADER_FOOTER", 0.95, 0.99), (1, 2, 3, "HEADER_FOOTER", 0.0, 0.02), (1, 2, 4, "STEM", 0.1, 0.5), (1, 2, 5, "EXPLANATION", 0.6, 0.95), (1, 3, 6, "QUESTION_NO", 0.05, 0.2)]
    got = S.mark_page_cuts(spark.createDataFrame(rows, "doc_id int, page int, nth int, kind string, y0 double, y1 double"))
    assert {r.nth: (r.goes_on, r.came_from) for r in got.collect()} == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True), 5: (False, False), 6: (False, False)}


def test_sections(spark):
    docs = list(papers(2, 60, ["STEM", "OPTION", "SECTION_HEADER", "SECTION_NOTE", "HEADER_FOOTER"]))
    sections, members = [], []
    for d, blocks in docs:
        number, part, cur, found = 0, "", None, []
        for nth, _, kind, text, *_ in blocks:
            if kind == "HEADER_FOOTER":
                continue
            if kind == "SECTION_HEADER" and text.startswith("第壹部分"):
                part = text.strip()
                continue
            if kind == "SECTION_HEADER" or cur is None:
                number += kind == "SECTION_HEADER"
                title = part if kind != "SECTION_HEADER" else f"{part} / {text.strip()}" if part else text.strip()
                cur = [number, title, [], []]
                found.append(cur)
                if kind == "SECTION_HEADER":
                    continue
            (cur[2] if kind == "SECTION_NOTE" else cur[3]).append((nth, kind, text))
        for number, title, notes, inside in found:
            if inside:
                sections.append((d, number, title, " ".join(t for _, _, t in notes).strip(" "), len(inside)))
                members += [(d, number, *x) for x in inside]
    a, b = S.split_sections(frame(spark, docs))
    assert sorted(tuple(r) for r in a.collect()) == sorted(sections)
    assert sorted(tuple(r) for r in b.collect()) == sorted(members)


@pytest.mark.parametrize("seed", [3, 4])
def test_exercises(spark, seed):
    docs = list(papers(seed, 60, ["STEM", "OPTION", "EXERCISE_HEADER", "EXPLANATION", "ANSWER_KEY", "TEACHING_NOTE", "HEADER_FOOTER"]))
    units, members = [], []
    for d, blocks in docs:
        found = []
        for _, page, kind, text, _, _, answers in blocks:
            if kind == "HEADER_FOOTER":
                continue
            if kind == "EXERCISE_HEADER":
                back = []
                while found and found[-1]["EXPLANATION"] and found[-1]["EXPLANATION"][-1][0] != "EXPLANATION":
                    back.insert(0, found[-1]["EXPLANATION"].pop())
                found.append({"label": text.strip(), "page": page, "answer": "", "STEM": back, "EXPLANATION": [], "NOTE": [], "solving": False})
            elif found:
                u = found[-1]
                if kind == "EXPLANATION":
                    u["solving"] = True
                    body = "" if text.strip() == "解" else text[1:].strip() if text.startswith("解 ") else text.strip()
                    if body:
                        u["EXPLANATION"].append((kind, body))
                elif kind == "ANSWER_KEY":
                    raw = " ".join(answers) if answers else text
                    raw = raw.strip()
                    u["answer"] = (raw[2:] if raw.startswith("答：") else raw).strip(" 。").strip()
                elif kind == "TEACHING_NOTE":
                    u["NOTE"].append((kind, text))
                else:
                    u["EXPLANATION" if u["solving"] else "STEM"].append((kind, text))
        for i, u in enumerate(found):
            if u["STEM"]:
                units.append((d, i + 1, u["label"], u["page"], u["answer"]))
                members += [(d, i + 1, part, k + 1, *x) for part in ("STEM", "EXPLANATION", "NOTE") for k, x in enumerate(u[part])]
    a, b = S.split_exercises(frame(spark, docs))
    assert sorted(tuple(r) for r in a.select("doc_id", "unit", "label", "page", "answer").collect()) == sorted(units)
    assert sorted(tuple(r) for r in b.select("doc_id", "unit", "part", "place", "kind", "text").collect()) == sorted(members)
    assert a.where(F.col("unit") < 1).count() == 0


def test_a_stroke_alone_is_a_figure(spark):
    rows = [(1, 1, 0.0, 0.0, 50.0, 50.0), (1, 2, 200.0, 200.0, 250.0, 260.0)]
    df = spark.createDataFrame(rows, "page int, stroke long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.figure for r in L.figures(df, least=1).collect()) == [1, 2]
