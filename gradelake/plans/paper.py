"""Registered queries on papers, options and calendar rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import paper as P
from ..sources import tables as T

NOW = "2001-09-01 00:00:00"


def spread_scores(s, d):
    """Each order as a paper of its line items with a total between 0 and 100 in steps of 0.25."""
    li = T.answers(s, d).select("attempt_id", "question_id")
    return P.spread_scores(li.withColumn("total", (F.col("attempt_id") % 401) * 0.25), "attempt_id", "question_id", "total").select("attempt_id", "question_id", "score")


def normalize_options(s, d):
    p = T.scan(s, d, "part")
    opt = lambda order, label, content: F.struct(order.cast("int").alias("order"), F.lit(label).alias("label"), content.alias("content"))
    k = F.col("p_partkey")
    options = F.array(opt((k % 5 + 1), "A", F.col("p_name")), opt((k % 3 + 6), "B", F.when(k % 4 == 0, "  ").otherwise(F.col("p_type"))), opt(F.lit(9), "C", F.when(k % 6 == 0, F.col("p_name")).otherwise(F.col("p_brand"))))
    o, keys, dropped, again = P.normalize_options(options, F.array((k % 5 + 1).cast("int"), (k % 3 + 6).cast("int"), F.lit(12)))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return p.select("p_partkey", F.array_join(F.transform(o, lambda x: F.concat(x["order"].cast("string"), F.lit(":"), x["content"])), "|").alias("options"), text(keys).alias("keys"), text(dropped).alias("dropped"), text(again).alias("duplicates"))


def paper_layout(s, d):
    """Seeded layouts: rows only, as the order comes from a Spark hash."""
    a = T.answers(s, d).select("attempt_id", "question_id", (F.col("question_id") % 7).alias("block"))
    return P.layout(a, "attempt_id", "block", "question_id", 17)


def question_usage(s, d):
    a = T.answers(s, d).join(T.attempts(s, d).select("attempt_id", "assignment_id"), "attempt_id")
    return P.usage(a, "question_id", "assignment_id")


def review_pace(s, d):
    e = T.scan(s, d, "events").select("user_id", F.col("value").alias("seconds"), (F.col("event_id") % 3).alias("questions"))
    return P.pace(e.withColumn("seconds", F.floor("seconds")), "user_id", "seconds", "questions")


def calendar_rules(s, d):
    o = T.attempts(s, d)
    year = (F.year("started_at") - 1911 + (F.col("attempt_id") % 3)).cast("int")
    n = F.lit(NOW).cast("timestamp")
    return o.select("attempt_id", F.date_format(dates.exam_date(year), "yyyy-MM-dd").alias("exam"), dates.upcoming_year("started_at").alias("upcoming"), dates.exam_passed(year, n).alias("passed"), dates.local_day("started_at").alias("day"), dates.local_minutes("started_at").alias("minutes"))


def threshold_trust(s, d):
    o = T.attempts(s, d)
    n = F.lit(NOW).cast("timestamp")
    stale, days = dates.stale_years(F.year("started_at"), F.when(F.col("attempt_id") % 2 == 0, F.year("started_at") + 1), F.lit(2001)), dates.age_days("started_at", n)
    return o.select("attempt_id", stale.alias("stale"), days.alias("days"), dates.trust(F.col("user_id") % 5, stale, days).alias("trust"))


NAMES = [spread_scores, normalize_options, paper_layout, question_usage, review_pace, calendar_rules, threshold_trust]
QUERIES = {f.__name__: f for f in NAMES}

ORACLES = {
    "spread_scores": T.sql(
        """SELECT attempt_id, question_id, CASE WHEN want = 0 THEN 0.0 ELSE floor((base + CASE WHEN i > n - (units - base * n) THEN 1 ELSE 0 END) * unit * 100 + 0.5) / 100 END AS score FROM (SELECT *, floor(units / n) AS base FROM (SELECT *, floor(want / unit + 0.5) AS units FROM (
  SELECT *, CASE WHEN want = floor(want) AND want >= n THEN 1.0::DOUBLE WHEN want * 2 = floor(want * 2) AND want * 2 >= n THEN 0.5::DOUBLE ELSE 0.01::DOUBLE END AS unit FROM (
  SELECT attempt_id, question_id, (attempt_id % 401) * 0.25::DOUBLE AS want, count(*) OVER (PARTITION BY attempt_id) AS n, row_number() OVER (PARTITION BY attempt_id ORDER BY question_id) AS i FROM answers))))""", "answers"),
    "normalize_options": """WITH o AS (SELECT p_partkey, unnest([1, 2, 3]) AS i, unnest([p_partkey % 5 + 1, p_partkey % 3 + 6, 9]) AS ord, unnest(['A', 'B', 'C']) AS label, unnest([p_name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE p_brand END]) AS content FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ord, i) AS nth, row_number() OVER (PARTITION BY p_partkey, content ORDER BY ord, i) AS again FROM o WHERE content <> '')
SELECT p_partkey, string_agg(nth || ':' || content, '|' ORDER BY nth) AS options, string_agg(CAST(nth AS VARCHAR), ',' ORDER BY nth) FILTER (i < 3) AS keys, CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 3 + 6) || ',12' ELSE '12' END AS dropped, coalesce(string_agg(label, ',' ORDER BY nth) FILTER (again > 1), '') AS duplicates FROM k GROUP BY p_partkey""",
    "question_usage": T.sql(
        "SELECT question_id, len(l) AS papers, array_to_string(l[1:3], ',') AS first, greatest(len(l) - 3, 0) AS more FROM (SELECT question_id, list_sort(list(DISTINCT assignment_id)) AS l FROM answers JOIN attempts USING (attempt_id) GROUP BY 1)", "attempts", "answers"),
    "review_pace": "SELECT user_id, n, floor(s / n * 100 + 0.5) / 100 AS seconds_each, floor(s / n * 50 / 60 * 10 + 0.5) / 10 AS minutes_to_target FROM (SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS s, CAST(nullif(sum(event_id % 3), 0) AS BIGINT) AS n FROM events GROUP BY 1)",
    "calendar_rules": T.sql(
        f"""SELECT attempt_id, CASE WHEN y BETWEEN 100 AND 200 THEN strftime(make_date(y + 1912, 1, 20), '%Y-%m-%d') END AS exam, CAST(CASE WHEN year(started_at) - 1912 BETWEEN 100 AND 200 AND started_at <= make_date(year(started_at), 1, 20) THEN year(started_at) - 1912 ELSE year(started_at) - 1911 END AS INT) AS upcoming,
  coalesce(y BETWEEN 100 AND 200 AND TIMESTAMP '{NOW}' > make_date(y + 1912, 1, 20), false) AS passed, strftime(started_at + INTERVAL 8 HOURS, '%Y-%m-%d') AS day, CAST(hour(started_at + INTERVAL 8 HOURS) * 60 + minute(started_at) AS INT) AS minutes FROM (SELECT *, CAST(year(started_at) - 1911 + attempt_id % 3 AS INT) AS y FROM attempts)""", "attempts"),
    "threshold_trust": T.sql(
        f"""SELECT attempt_id, stale, days, (['WEAK', 'WORKABLE', 'SOLID'])[greatest(0, CASE WHEN user_id % 5 >= 3 THEN 2 WHEN user_id % 5 >= 1 THEN 1 ELSE 0 END - CAST(stale > 0 AS INT) - CAST(days > 365 AS INT)) + 1] AS trust FROM (
  SELECT *, CAST(greatest(0, 2001 - CASE WHEN attempt_id % 2 = 0 THEN year(started_at) + 1 ELSE year(started_at) END) AS INT) AS stale, CAST(greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(started_at)) / 86400)) AS BIGINT) AS days FROM attempts)""", "attempts"),
}
