"""What the findings of round 4 were about, each held by a small case."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from gradelake.operators import graph, layout, stats


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def steps(monkeypatch):
    """The plans, as run, of all tables that the operators store."""
    plans, stored = [], graph.stored

    def seen(df, name="step"):
        plans.append(_final_plan(df))
        return stored(df, name)

    for module in (graph, layout):
        monkeypatch.setattr(module, "stored", seen)
    return plans


def test_figures_broadcast_no_lattice(spark, steps):
    s = spark.range(120).select((F.col("id") % 3).alias("page"), F.col("id").alias("stroke"), (F.col("id") * 37 % 211).cast("double").alias("x0"), (F.col("id") * 53 % 197).cast("double").alias("y0"))
    s = s.withColumn("x1", F.col("x0") + F.col("stroke") % 40).withColumn("y1", F.col("y0") + F.col("stroke") % 29)
    steps.append(_final_plan(layout.figures(s)))
    assert sum("SortMergeJoin" in p for p in steps) > 5 and not any("Broadcast" in p for p in steps)


def test_components_broadcast_no_nodes(spark, steps):
    steps.append(_final_plan(graph.components(spark.range(50).selectExpr("id as src", "id + 1 as dst"))))
    assert sum("SortMergeJoin" in p for p in steps) > 5 and not any("Broadcast" in p for p in steps)


def test_totals_do_not_follow_the_order_of_answers(spark):
    """A mean of 494.5 thousandths; only orders of the second attempt's answers are tried, in which sums differ in the last bit."""
    papers = [[(47, 0.09), (44, 0.05), (46, 0.04), (34, 0.07)], [(7, 0.09), (28, 0.0), (25, 0.02), (40, 0.04)], [(26, 0.03), (36, 0.02), (49, 0.05), (3, 0.01), (15, 0.08), (39, 0.07)], [(21, 0.08), (13, 0.05), (48, 0.06)]]
    attempts, answers, n = [], [], 0
    for user, order in enumerate(itertools.permutations(papers[1])):
        for nth, paper in enumerate([papers[0], order, *papers[2:]]):
            attempts.append((n, 1, user, -nth))
            answers += [(n, q * (1 - off), True) for q, off in paper]
            n += 1
    a = spark.createDataFrame(attempts, "attempt_id int, assignment_id int, user_id int, started_at int")
    t = stats.with_totals(a, spark.createDataFrame(answers, "attempt_id int, earned double, is_correct boolean").coalesce(1))
    totals = [sum(q * (100 - round(off * 100)) for q, off in paper) / 100 for paper in papers]
    assert {(r.started_at, r.total_score) for r in t.collect()} == {(-nth, x) for nth, x in enumerate(totals)}
    so = 0.0
    for x in totals:
        so += x / 250
    assert {r.own_mean for r in stats.student_vs_peers(t).collect()} == {math.floor(so / 4 * 100 * 10 + 0.5) / 10} == {49.5}


def test_a_total_of_nothing_graded_is_null(spark):
    a = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 2)], "attempt_id int, assignment_id int, user_id int, started_at int")
    t = stats.with_totals(a, spark.createDataFrame([(1, None, None), (1, None, None)], "attempt_id int, earned double, is_correct boolean"))
    assert {(r.attempt_id, r.total_score, r.pending, r.attempt_no) for r in t.collect()} == {(1, None, 2, 1), (2, None, None, 2)}
