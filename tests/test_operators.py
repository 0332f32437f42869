"""Operators on small tables with stated or brute-force results."""

from __future__ import annotations

import itertools
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import admission, documents, grading, graph, proctor, roster, star
from gradelake.sources import files
from gradelake.streaming import proctor as live
from gradelake.streaming.tables import run_available


def test_star_ranking_order(spark):
    rows = [("c", 8.0, "X", 1, 1), ("a", 1.5, "X", 1, 1), ("b", 4.2, "X", 1, 1), ("a", 1.5, "Y", 1, 2)]
    got = star.ranking(spark.createDataFrame(rows, "user_id string, percentile double, institution string, star_group int, wish_rank int")).orderBy("order").collect()
    assert [(r["user_id"], r["order"], r["nominated"]) for r in got] == [("a", 1, True), ("b", 2, True), ("c", 3, False)]


def test_consensus(spark):
    rows = [("p", 18.0, 0.7)] * 3 + [("q", 9.0, 0.7), ("q", 14.0, 0.7), ("q", 20.0, 0.7)]
    got = {r["k"]: r for r in grading.sample_consensus(spark.createDataFrame(rows, "k string, suggested_score double, confidence double"), "k").collect()}
    assert (got["p"]["median"], got["p"]["spread"], got["p"]["confidence"]) == (18.0, 0.0, 0.7)
    assert (got["q"]["median"], got["q"]["spread"], got["q"]["unstable"]) == (14.0, 11.0, True) and got["q"]["confidence"] <= 0.4


def test_votes(spark):
    rows = [(1, 0, [2])] + [(2, i, [3, 1]) for i in range(3)]
    df = spark.createDataFrame(rows, "q int, attempt_idx int, answer_keys array<int>")
    got = grading.vote_tally(df.where("q = 1"), "q", 5).first()
    assert (got["consistency"], got["tier"], got["autofill"]) == (0.2, "low", False)
    assert grading.vote_tally(df.where("q = 2"), "q", 3).first()["consistency"] == 1.0


def test_calibration_alerts_need_enough_rows(spark):
    rows = [("big", 10, 12, 0.7, 11 if i < 18 else 5) for i in range(40)] + [("small", 10, 12, 0.7, 11 if i < 3 else 5) for i in range(8)] + [("small", 3, 1, 0.7, 5), ("small", 1, 3, 0.7, None)]
    df = spark.createDataFrame(rows, "g string, interval_low int, interval_high int, confidence double, actual_grade int")
    got = {(r["g"], r["band"]): r for r in grading.calibration_curve(df, ["g"]).collect()}
    assert len(got) == 10
    assert got["big", 3]["alert"] == "OVER" and got["big", 3]["hit"] == 18
    assert got["small", 3]["alert"] is None and got["small", 3]["n"] == 8
    c = {r["g"]: r for r in grading.calibration_counts(df, ["g"]).collect()}["small"]
    assert (c["malformed"], c["pending"], c["known"]) == (1, 1, 8)


def test_eligibility_over_all_profiles(spark):
    flags = ["special_admitted", "special_waived", "is_repeater", "same_school_all", "star_waived", "apply_admitted", "apply_waived"]
    rows = [(i, *bits, cat) for i, (*bits, cat) in enumerate(itertools.product(*[[False, True]] * 7, ["NONE", "GROUP_1_7", "GROUP_8"]))]
    df = spark.createDataFrame(rows, "user_id int, " + ", ".join(f"{f} boolean" for f in flags) + ", star_category string")
    got = {(r["user_id"], r["action"]): r["ok"] for r in admission.eligibility(df).collect()}
    for i, sa, sw, rep, same, stw, aa, aw, cat in rows:
        special = sa and not sw
        assert got[i, "SPECIAL_APPLY"]
        assert got[i, "STAR_APPLY"] == (not special and not rep and same)
        assert got[i, "APPLY_APPLY"] == (cat != "GROUP_1_7" and not special)
        assert got[i, "APPLY_PREFERENCE"] == (cat == "NONE" and not special)
        assert got[i, "PLACEMENT_REGISTER"] == (not special and not (cat != "NONE" and not stw) and not (aa and not aw))
    blank = spark.createDataFrame([(1,)], "user_id int").select("user_id", *[F.lit(None).cast("boolean").alias(f) for f in flags], F.lit(None).cast("string").alias("star_category"))
    assert all(r["ok"] for r in admission.eligibility(blank).collect())


def test_rank_rows(spark):
    rows = [(2, "u1", "３.５％", ""), (3, "u1", "4", "6"), (4, "", "5", ""), (5, "u2", "x", ""), (6, "u2", "101", ""), (7, "u2", "12.5%", "4"), (8, " ", None, None)]
    got = {r["line"]: r for r in admission.rank_rows(spark.createDataFrame(rows, "line int, username string, percentile string, semesters string")).collect()}
    assert set(got) == {2, 3, 4, 5, 6, 7}
    assert (got[2]["percentile"], got[2]["semesters"], got[2]["problem"]) == (3.5, 5.0, None)
    assert [got[i]["problem"] for i in (3, 4, 5, 6)] == ["DUPLICATE", "NO_USERNAME", "NOT_A_NUMBER", "OUT_OF_RANGE"]
    assert (got[7]["percentile"], got[7]["semesters"]) == (12.5, 4.0)


def test_cohort_gate(spark):
    t = lambda x: x
    rows = [(1, 1, t("2024-01-01 00:00:00")), (2, 1, t("2024-03-01 00:00:00")), (3, 2, None), (4, 2, t("2024-02-01 00:00:00")), (5, 3, t("2023-01-01 00:00:00"))]
    df = spark.createDataFrame(rows, "assignment_id int, paper_id int, due string").select("assignment_id", "paper_id", F.col("due").cast("timestamp").alias("due_at"))
    got = {r["assignment_id"]: r for r in roster.cohort_gate(df, "2024-01-15 00:00:00").collect()}
    assert str(got[1]["due_at"])[:10] == "2024-03-01" and got[1]["blocked_by"] == 1
    assert got[4]["unbounded"] and got[4]["due_at"] is None and got[4]["blocked_by"] == 1
    assert not got[3]["unbounded"] and str(got[3]["due_at"])[:10] == "2024-02-01"
    assert str(got[5]["due_at"])[:10] == "2023-01-01" and got[5]["blocked_by"] == 0


def test_cycles_and_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    reach = graph.closure(e)
    got = graph.cycles(e).collect()
    assert {r["node"] for r in got} == {"a", "b", "c"} and {r["cycle"] for r in got} == {"a"}
    assert {(r["src"], r["dst"]) for r in reach.collect()} >= {("d", "c"), ("a", "a")}
    assert {r["component"] for r in graph.components(e).collect()} == {"a"}


def test_levels_and_components_of_a_long_chain(spark):
    e = spark.range(1000).selectExpr("id as src", "id + 1 as dst")
    e = e.union(spark.createDataFrame([(3000, 3001), (3001, 3000), (3002, 3000)], "src long, dst long"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    got = {r["node"]: r["level"] for r in graph.levels(e, nodes).collect()}
    assert got == {i: 1000 - i for i in range(1001)} | {3000: None, 3001: None, 3002: None}
    assert {(r["node"], r["component"]) for r in graph.components(e).collect()} == {(i, 0) for i in range(1001)} | {(i, 3000) for i in (3000, 3001, 3002)}


def test_fullscreen_exits_never_fall_below_zero(spark):
    rows = [(i, "x", kind, f"2024-01-01 00:00:{i:02d}", 100) for i, kind in enumerate(["FULLSCREEN_ENTER", "FULLSCREEN_EXIT", "FULLSCREEN_EXIT", "FULLSCREEN_ENTER", "TAB_VISIBLE"])]
    df = spark.createDataFrame(rows, "event_id int, attempt_id string, type string, at string, duration_ms long").withColumn("at", F.col("at").cast("timestamp"))
    got = proctor.summary(df).first()
    assert (got["events"], got["away"], got["exits"]) == (5, 1, 1)


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(20, 8))
    x = np.concatenate([base, base + r.normal(scale=0.1, size=base.shape), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {(a["query_id"], a["vec_id"]) for a in documents.similar_vectors(df.where("vec_id % 5 = 0"), df, 0.92, block=7).collect()}
    n = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = n @ n.T
    assert got == {(i, j) for i in range(0, len(x), 5) for j in range(len(x)) if i != j and c[i, j] >= 0.92}
    assert got


def test_greedy_match(spark):
    left = [(1, 0, "the red house"), (1, 1, "the blue house"), (2, 0, "zzz")]
    right = [(1, 5, "a blue house"), (1, 6, "the red house!"), (2, 0, "qqq")]
    kind = "doc long, item long, text string"
    got = {(r["doc"], r["left_item"], r["right_item"]) for r in documents.match_greedily(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect()}
    assert got == {(1, 0, 6), (1, 1, 5)}
    assert SequenceMatcher(None, "a blue house", "the blue house").ratio() > 0.62


def test_upsert_and_violations(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert {(r["k"], r["x"]) for r in roster.upsert_latest(old, new, ["k"], "v").collect()} == {(1, "c"), (2, "b"), (3, "e")}
    df = spark.createDataFrame([(1, -1), (2, 5), (3, None)], "k int, score int")
    assert [(r["k"], r["rule"]) for r in roster.violations(df, {"score >= 0": F.col("score") >= 0}, "k").collect()] == [(1, "score >= 0")]


def test_uploaded_tables_in_several_encodings(spark, tmp_path):
    text = '學號（必填）,姓名\r\n"a,1","王""小""明"\r\n,\r\nb2,李四\r\n'
    for name, raw in {"u8.csv": b"\xef\xbb\xbf" + text.encode(), "big5.csv": text.encode("big5"), "u16.csv": b"\xff\xfe" + text.encode("utf-16-le")}.items():
        (tmp_path / name).write_bytes(raw)
    t = files.read_tables(spark, f"file://{tmp_path}")
    got = files.named_columns(t, {"username": ["student_id", "學號"], "name": ["姓名"], "none": ["班級"]}).orderBy("path", "line").collect()
    assert [(r["line"], r["username"], r["name"], r["none"]) for r in got] == [(2, "a,1", '王"小"明', None), (4, "b2", "李四", None)] * 3
    assert {r["encoding"] for r in t.select("encoding").distinct().collect()} == {"utf-8-bom", "big5", "utf-16le"}


def test_replacing_partitions_twice_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.append(spark.createDataFrame([(1, "a"), (2, "b")], "p int, x string"), path, ["p"])
    for _ in range(2):
        files.replace_partitions(spark.createDataFrame([(2, "c")], "p int, x string"), path, ["p"])
    assert {(r["p"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_file_kinds(spark):
    rows = [(b"%PDF-1.7",), (b"\x89PNG\r\n\x1a\n",), (b"RIFF\x00\x00\x00\x00WEBP",), (b"hello",), (None,)]
    assert [r["k"] for r in spark.createDataFrame(rows, "c binary").select(files.file_kind(F.col("c")).alias("k")).collect()] == ["pdf", "png", "webp", "unknown", "unknown"]


def _stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).parquet(f"file://{tmp_path}/in")


def test_streamed_repeats_and_throttle(spark, tmp_path):
    rows = [(1, "k1", "2024-01-01 00:00:00"), (2, "k1", "2024-01-01 00:01:00"), (3, "k2", "2024-01-01 00:01:00")]
    s = _stream_of(spark, tmp_path, rows, "note_id long, key string, at string")
    assert sorted(r["key"] for r in run_available(live.first_only(s, ["key"])).collect()) == ["k1", "k2"]
    notes = s.select(F.lit(1).cast("long").alias("user_id"), "note_id", F.lit(0).cast("long").alias("at_ms"))
    more = notes.union(notes.withColumn("note_id", F.col("note_id") + 10))
    got = sorted(r["send_ms"] for r in run_available(live.throttled(more)).collect())
    assert got == [0, 0, 0, 60_000, 60_000, 60_000]


@pytest.mark.parametrize("seed", [2, 3])
def test_levels_and_cycles_of_random_graphs(spark, seed):
    import random

    r = random.Random(seed)
    n, m = [(30, 40), (40, 55), (60, 150), (25, 25)][seed]
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    if seed == 2:
        edges = {(max(a, b), min(a, b)) for a, b in edges if a != b}  # wide and free of cycles
    if seed == 3:
        edges |= {(i, (i + 1) % 12) for i in range(12)} | {(20, 3), (5, 21), (24, 24)}
    reach = {a: {b for x, b in edges if x == a} for a in range(n)}
    for _ in range(n):
        for a in reach:
            reach[a] = reach[a].union(*[reach[b] for b in reach[a]])
    on = {a for a in reach if a in reach[a]}
    level = {}

    def deep(a):
        if a in on or reach[a] & on:
            return None
        if a not in level:
            level[a] = max((1 + deep(b) for x, b in edges if x == a), default=0)
        return level[a]

    e = spark.createDataFrame(sorted(edges) + [(None, 1), (2, None)], "src long, dst long")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    assert {x["node"]: x["level"] for x in graph.levels(e, nodes).collect()} == {a: deep(a) for a in range(n)}
    want = {(min(b for b in on if b in reach[a] and a in reach[b]), a) for a in on}
    assert {(x["cycle"], x["node"]) for x in graph.cycles(e).collect()} == want


def test_stored_tables_go_with_their_scope(spark):
    import os

    from gradelake.sources import shared

    def here():
        root = f"{shared.shared_dir(spark)}/gradelake-{spark.sparkContext.applicationId}".removeprefix("file://")
        return set(os.listdir(root)) if os.path.isdir(root) else set()

    before = here()
    e = spark.range(5).selectExpr("id as src", "id + 1 as dst")
    with shared.scope(spark):
        assert graph.components(e).count() == 6
        assert len(here()) > len(before)
        with shared.scope(spark):
            assert graph.cycles(e).count() == 0
    assert here() == before


def test_similar_texts_are_exact_with_few_pairs(spark):
    import random

    from gradelake.operators import documents as D

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    items = [(i, " the ".join(word() for _ in range(r.randint(1, 9)))) for i in range(150)] + [(150, ""), (151, None)]
    ask = [(i, " ".join([*r.choice(items[:150])[1].split()[: r.randint(2, 9)], word()])) for i in range(60)] + [(60, ""), (61, None)]
    grams = lambda t: {x[i : i + 3] for x in ["  " + t.lower() + " "] for i in range(len(x) - 2)} if t is not None else set()
    sim = {(a, b): int(len(x & y) / len(x | y) * 1e6 + 0.5) / 1e6 for a, s in ask for b, t in items for x, y in [(grams(s), grams(t))] if x & y}
    q, c = spark.createDataFrame(ask, "query_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for least, k in ((0.0, 5), (0.25, 5), (0.0, 200)):
        want = []
        for a, _ in ask:
            top = sorted((-v, b) for (x, b), v in sim.items() if x == a and v >= least)[:k]
            want += [(a, b, -v, n + 1) for n, (v, b) in enumerate(top)]
        got = D.similar_texts(q, c, k, least).collect()
        assert sorted((x.query_id, x.item_id, round(x.similarity, 6), x.nth) for x in got) == sorted((a, b, round(v, 6), n) for a, b, v, n in want)
    counts = q.select("text").union(c.select("text")).select(F.explode(D.X.trigrams("text")).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    pairs = {(x.query_id, x.item_id) for x in D.text_pairs(D._rarest_first(q, "query_id", counts), D._rarest_first(c, "item_id", counts), 0.3).collect()}
    assert pairs >= {p for p, v in sim.items() if v >= 0.3} and len(pairs) < len(sim) / 4
