"""What the findings of round 3 were about, each held by a small case."""

import functools
import math
import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gradelake.functions import interview
from gradelake.functions.numeric import one_decimal
from gradelake.functions.text import condensed
from gradelake.llm import pieces
from gradelake.operators import documents, formulas, grading, layout, placement, portfolio, reading, stats
from gradelake.plans import ORACLES, parsing, relational


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_draw_is_worked_out_once(spark):
    steps = {"A": [0.2, 0.5, 0.9], "B": [0.1, 0.6, 0.8]}
    draws = spark.range(1000).withColumnRenamed("id", "draw")
    drawn = placement.draw_grades(draws, 7, steps, {"A": 0.5, "B": 0.5})
    assert _plan(drawn).upper().count("COS(") == 3  # one for the factor, one for each subject
    one = spark.range(1).select(placement.grade_at(F.cos("id"), [0.1, 0.5, 2.0]).alias("g"))
    assert "< COS(" not in _plan(one).upper() and one.first().g == 2


def _figures(strokes, gap, least, size):
    """Figures by comparing all strokes of a page."""
    at = {s[1]: s[1] for s in strokes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in strokes:
        for b in strokes:
            if a[0] == b[0] and a[2] - gap < b[4] and a[4] + gap > b[2] and a[3] - gap < b[5] and a[5] + gap > b[3]:
                x, y = sorted((root(a[1]), root(b[1])))
                at[y] = x
    out = {}
    for s in strokes:
        out.setdefault((s[0], root(s[1])), []).append(s)
    boxes = [(p, f, len(v), min(s[2] for s in v), min(s[3] for s in v), max(s[4] for s in v), max(s[5] for s in v)) for (p, f), v in out.items()]
    return sorted(b for b in boxes if b[2] >= least and b[5] - b[3] >= size and b[6] - b[4] >= size)


def test_figures_of_random_pages_by_all_pairs(spark):
    rng, strokes = random.Random(3), []
    for page in range(40):
        for _ in range(rng.choice([3, 15, 40])):
            x, y = rng.randrange(160), rng.randrange(160)
            w, h = rng.choice([(0, 0), (1, 30), (30, 1), (9, 9), (4, 17)])
            strokes.append((page, len(strokes), float(x), float(y), float(x + w), float(y + h)))
    got = layout.figures(spark.createDataFrame(strokes, "page int, stroke long, x0 double, y0 double, x1 double, y1 double"), least=2, size=5.0)
    got = sorted(tuple(r[c] for c in ("page", "figure", "strokes", "x0", "y0", "x1", "y1")) for r in got.collect())
    assert got == _figures(strokes, 9.0, 2, 5.0) and len(got) > 60


def test_figures_link_no_pairs(spark):
    s = spark.range(300).select(F.lit(1).alias("page"), F.col("id").alias("stroke"), (F.col("id") % 17).cast("double").alias("x0"), (F.col("id") % 13).cast("double").alias("y0"))
    links = layout._touching(s.withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 5), 9.0)[1]
    assert links.count() < 300


def test_equal_places_and_boxes_meet_once(spark):
    rng = random.Random(5)
    points = [(i % 2, i, float(rng.randrange(6)), float(rng.randrange(6))) for i in range(300)]
    boxes = [(rng.randrange(2), i, float(x := rng.randrange(5)), float(y := rng.randrange(5)), float(x + rng.randrange(3)), float(y + 1)) for i in range(200)]
    p = spark.createDataFrame(points, "page int, point_id long, x double, y double")
    out = documents.contained(p, spark.createDataFrame(boxes, "page int, box_id long, x0 double, y0 double, x1 double, y1 double"), ["page"])
    want = {}
    for page, i, x, y in points:
        fit = [((b[4] - b[2]) * (b[5] - b[3]), b[1]) for b in boxes if b[0] == page and b[2] <= x <= b[4] and b[3] <= y <= b[5]]
        if fit:
            want[page, i] = (min(fit)[1], len(fit))
    assert {(r.page, r.point_id): (r.box_id, r.boxes) for r in out.collect()} == want
    join = _plan(out).split("Join Inner")[-1]  # places against boxes: both sides grouped first
    assert join.count("Aggregate") == 2


def test_one_decimal_as_c_prints_it(spark):
    rng = random.Random(7)
    xs = [0.25, 0.75, 0.35, 0.05, 0.15, 28.95, 93.25, 99.95, -0.04, -0.25, -9.95, 0.0] + [rng.randrange(-99999, 999999) / 10000 for _ in range(20000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", one_decimal("x").alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.x:.1f}" for r in rows]


def test_means_halfway_are_added_newest_first(spark):
    scores, orders = [50.7, 125.25, 57.5, 150.05, 19.6, 170.9, 120.8, 70.2], {}  # a mean of 382.5 thousandths
    rows = []
    for u in range(200):
        orders[u] = rng_order(scores, u)
        rows += [(u, i * 7 % 8, u * 10 + i, x, i) for i, x in enumerate(orders[u])]
    t = spark.createDataFrame(rows, "user_id int, assignment_id int, attempt_id int, total_score double, started_at int").coalesce(1)
    want = {u: math.floor(functools.reduce(lambda so, x: so + x / 250, reversed(v), 0.0) / 8 * 100 * 10 + 0.5) / 10 for u, v in orders.items()}
    assert len(set(want.values())) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # joins by sorting, as on large tables
    try:
        assert {r.user_id: r.own_mean for r in stats.student_vs_peers(t).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rng_order(xs, seed):
    xs = list(xs)
    random.Random(seed).shuffle(xs)
    return xs


def test_own_cover_works_texts_out_once(spark):
    df = spark.createDataFrame([("abcdefgh-ij", "abcdefgh xyz")], "said string, own string")
    out = df.select(portfolio.own_cover(condensed("said"), condensed("own")).alias("share"))
    assert abs(out.first().share - 5 / 7) < 1e-12
    assert _plan(out).count("regexp_replace") == 2  # before: one at each place, and two more


def test_sketches_are_by_type_only(spark):
    plan = relational.approx_distinct(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_user = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "user_id" in line.split("]")[0]]
    assert by_user and not any("approx_count_distinct" in line for line in by_user)


def test_figures_without_a_gap(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, 5.0, 0.0, 9.0, 5.0), (1, 3, 4.0, 4.0, 6.0, 6.0), (1, 4, 20.0, 0.0, 25.0, 5.0)]
    got = layout.figures(spark.createDataFrame(rows, "page int, stroke long, x0 double, y0 double, x1 double, y1 double"), gap=0.0, least=1, size=0.0).collect()
    assert sorted((r.figure, r.strokes) for r in got) == [(1, 3), (4, 1)]


def test_trigram_search_in_blocks_equals_its_sql(spark, tmp_path):
    """Blocks of few texts, ties, and query ids that two turns share (a turn numbered 1000)."""
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcÈé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 8)))
    turns = [(c, t, "user", text()) for c in range(3) for t in (0, 1, 2, 1000)] + [(7, 0, "user", None), (7, 1, "user", "")]
    items = [(i, text()) for i in range(45)] + [(50, None), (51, "")]
    q = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    c = spark.createDataFrame(items, "item_id long, text string")
    q.write.parquet(f"{tmp_path}/conversations.parquet")
    c.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["trigram_topk"]).fetchall())
    ids = q.selectExpr("conv_id * 1000 + turn as query_id", "text")
    for block in (4, 1024):
        assert sorted(tuple(x) for x in documents.similar_texts(ids, c, block=block).select("query_id", "item_id", "similarity", "nth").collect()) == want


def test_an_answer_is_put_together_and_judged_once(spark, tmp_path):
    spark.createDataFrame([(i, i) for i in range(3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    plan = _plan(parsing.interview_structure(spark, str(tmp_path)))
    assert plan.count("array_join(") == 2  # the answer, and what is asked


def test_plain_alternatives_are_found_as_by_the_pattern(spark):
    r = random.Random(3)
    patterns = [*interview.CONCRETE.values(), *interview.VAGUE, *[p for two in interview.AGAINST.values() for p in two], *[p for two in interview.WANTED.values() for p in two if p]]
    signs = [p.replace("?:", "").translate(str.maketrans("", "", "()[]{}?*+\\|")) for p in patterns]
    texts = ["".join(s[(i := r.randrange(len(s))) : i + r.randint(1, 5)] for s in r.choices(signs, k=3)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(*[(interview.says(F.col("t"), p) == F.col("t").rlike(p)).alias(f"c{i}") for i, p in enumerate(patterns)], *[F.col("t").rlike(p).alias(f"d{i}") for i, p in enumerate(patterns)]).collect()
    assert all(all(x[: len(patterns)]) for x in rows) and sum(any(x[len(patterns) + i] for x in rows) for i in range(len(patterns))) > len(patterns) / 2


def test_an_entry_text_is_read_once(spark, tmp_path):
    spark.createDataFrame([(i, i) for i in range(3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    plan = _plan(parsing.qualify_parts(spark, str(tmp_path)))
    assert plan.count("split(") == 1 and plan.count("標, 0)") <= 2


def test_pages_of_a_batch_are_read_side_by_side(spark):
    boxes = [(1, k, *(x, 0.1 + y * 0.2, x + 0.4, 0.25 + y * 0.2)) for k, (x, y) in enumerate((x, y) for y in range(3) for x in (0.0, 0.6))]
    cut = float(reading.gutters(np.array([b[2:] for b in boxes]), np.zeros(6, int), np.array([6]))[0])
    boxes += [(1, 9, cut, 0.9, cut, 0.95), (2, 0, 0.0, 0.5, 1.0, 0.6), (2, 1, 0.0, 0.1, 1.0, 0.2)]  # a block without width lies on the cut of page 1
    df = spark.createDataFrame(boxes, "page int, block int, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    got = [(r.page, r.block) for r in reading.reading_order(df).orderBy("page", "place").collect()]
    assert got == [(1, 0), (1, 2), (1, 4), (1, 9), (1, 1), (1, 3), (1, 5), (2, 1), (2, 0)]


def test_a_paper_meets_its_responses_inside_the_attempt(spark):
    items = spark.createDataFrame([(1, q, q, "SINGLE", 5.0, [1], 4, False) for q in (1, 2, 3)], "paper_id int, question_id int, order int, type string, score double, correct_keys array<int>, option_count int, award_all boolean")
    given = spark.createDataFrame([(7, 1, 1, [1]), (7, 1, 3, [2]), (7, 1, 3, [1]), (8, 1, 2, None), (9, 2, 1, [1])], "attempt_id int, paper_id int, question_id int, answer_keys array<int>")
    graded = grading.grade_items(items, given)
    assert sorted((r.attempt_id, r.question_id, r.verdict) for r in graded.collect()) == [(7, 1, "CORRECT"), (7, 2, "BLANK"), (7, 3, "CORRECT"), (7, 3, "WRONG"), (8, 1, "BLANK"), (8, 2, "BLANK"), (8, 3, "BLANK")]
    assert _plan(graded).count("Join ") == 1  # whole papers are not joined with responses again


def test_words_by_levels_equal_words_one_by_one():
    r = random.Random(9)
    scores = {c: -3.0 - i / 7 for i, c in enumerate("▁abcd")} | {p: -1.0 - i / 3 for i, p in enumerate(["ab", "▁a", "bc", "abc", "▁ab", "cd", "▁abc", "bcd", "aa", "xa"])}
    words = {"▁" + "".join(r.choices("aaabbccdxé字", k=r.randint(0, 12))) for _ in range(3000)} | {"", "▁" + "ab" * 40}
    for kind in ("bpe", "unigram"):
        model = pieces.PieceModel({p: (i + 300, s) for i, (p, s) in enumerate(scores.items())}, list(range(256)), kind)
        assert model.encode_words(words) == model._one_by_one(list(words))
        codes = [c for c, _, _ in model.encode_words(words).values()]
        assert model.decode_all([*codes, b""]) == [model.decode(np.frombuffer(c, np.uint32).tolist()) for c in codes] + [""]


def test_a_level_of_the_trie_is_one_step(monkeypatch):
    calls = []
    step = pieces._Trie.step
    monkeypatch.setattr(pieces._Trie, "step", lambda *a: calls.append(1) or step(*a))
    model = pieces.PieceModel({c: (i, -1.0) for i, c in enumerate(["▁", "a", "b", "ab", "▁a"])}, list(range(256)))
    model.encode_words({f"▁{'ab' * (i % 9)}{i}" for i in range(2000)})
    assert 0 < len(calls) < 200


def test_match_ratio_equals_difflib():
    r = random.Random(4)
    word = lambda k: "".join(r.choices("abcde éß字🙂"[:k], k=r.randint(0, 40)))
    for n in range(600):
        a, b = word(2 + n % 9), word(2 + n % 9)
        b = b if n % 3 else b + a[n % 7 : 20] + b
        want = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert documents.match_ratio(a, b) == want == documents.match_ratio(a, b, cells=10)
        for least in (0.3, 0.62, want):
            assert documents.match_ratio(a, b, least) == (want if want >= least else None)


def test_documents_to_match_are_dealt_to_many_tasks(spark):
    rows = spark.range(200).selectExpr("id as doc", "id as item", "concat('text of ', id) as text")
    assert documents.match_greedily(rows, rows).rdd.getNumPartitions() >= 16  # small texts are not put together into one task


def test_greedy_match_equals_pairs_by_difflib(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choices(["red", "house", "blue", "a", "the", "tree"], k=r.randint(0, 9)))
    left, right = ([(d, i, text()) for d in range(12) for i in range(5)] for _ in range(2))
    want = set()
    for d in range(12):
        pairs = [(-SequenceMatcher(None, y, x, autojunk=False).ratio(), i, j) for e, i, x in left if e == d for f, j, y in right if f == d]
        used = set()
        for q, i, j in sorted(p for p in pairs if -p[0] >= 0.62):
            if not used & {("l", i), ("r", j)}:
                used |= {("l", i), ("r", j)}
                want.add((d, i, j, round(-q, 6)))
    kind = "doc long, item long, text string"
    got = documents.match_greedily(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind))
    assert {tuple(x) for x in got.select("doc", "left_item", "right_item", "ratio").collect()} == want


def test_assets_are_dealt_to_their_questions_once(spark):
    texts = [(1, "STEM", "![[a:x]] ![[a:y]] ![[a:x]]"), (1, "A", "![[a:y]]![[a:q]]"), (1, "B", None), (2, "A", "none"), (None, "A", "![[a:x]]"), (3, "STEM", "![[a:z]]")]
    assets = [(1, 0, "z"), (1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (1, 4, "w"), (2, 0, "x"), (2, None, "v"), (None, 0, "x"), (4, 5, None)]
    t, a = spark.createDataFrame(texts, "question_id long, place string, text string"), spark.createDataFrame(assets, "question_id long, nth int, asset string")
    rows = layout.assets_in_place(t, a)
    want = {(1, "STEM", 1, "x"), (1, "STEM", 2, "y"), (1, "STEM", 3, "z"), (1, "STEM", 4, "w"), (1, "A", 1, "y"), (1, "A", None, "q"), (2, "STEM", 2, "x"), (2, "STEM", 1, "v"), (None, "A", None, "x"), (None, "STEM", 1, "x"), (3, "STEM", None, "z"), (4, "STEM", 1, None)}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    placed, missing = layout.placed_assets(t, a)
    assert {tuple(r) for r in placed.collect()} == {w for w in want if w[2]} and {tuple(r) for r in missing.collect()} == {(q, p, x) for q, p, n, x in want if not n}
    plan = _plan(rows)
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_large_pages_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    glyphs = spark.range(900).selectExpr("id % 300 as page", "cast(id as double) as x0", "cast(id + 5 as double) as x1", "10.0D as base", "10.0D as size")
    rules = spark.range(300).selectExpr("id as page", "0 as rule", "cast(id as double) as x0", "cast(id + 5 as double) as x1", "5.0D as y")
    whole = sorted(tuple(r) for r in formulas.rule_roles(glyphs, rules).collect())
    monkeypatch.setattr(formulas, "TASK_ROWS", 100)
    cut = formulas.rule_roles(glyphs, rules)
    assert cut.rdd.getNumPartitions() == 12 and sorted(tuple(r) for r in cut.collect()) == whole
