"""Registered queries on the ordinary relational surface: joins, grouping sets, frames, set operations, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import round_half_up
from ..sources import tables as T


def asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: one union, one shuffle by key, one running last."""
    l = left.withColumn("_t", F.col(left_at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(key, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    u = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return u.where("_side = 1").drop("_t", "_side", "_v")


def join_outer(s, d):
    o = T.attempts(s, d).groupBy("user_id").agg(F.count("*").alias("attempts"))
    v = T.scan(s, d, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return o.join(v, "user_id", "full")


def join_semi(s, d):
    return T.users(s, d).join(T.scan(s, d, "events"), "user_id", "left_semi").select("user_id", "class_id")


def join_anti(s, d):
    return T.users(s, d).join(T.scan(s, d, "events"), "user_id", "left_anti").select("user_id", "class_id")


def join_range(s, d):
    """Events by the band of values that holds them: an equi-join on the band's number, then the exact bounds."""
    bands = T.scan(s, d, "nation").select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 10.0).alias("low"), (F.col("n_nationkey") * 10.0 + 12.0).alias("high"))
    cells = bands.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / 10), F.floor(F.col("high") / 10))))
    e = T.scan(s, d, "events").select("event_id", "value", F.floor(F.col("value") / 10).alias("cell"))
    return e.join(cells, "cell").where("value >= low and value < high").groupBy("band").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def join_asof(s, d):
    e = T.scan(s, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return asof(left, right, "user_id", "ts", "ts", "last_view").select("event_id", "user_id", "last_view")


def _sales(s, d):
    return T.scan(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))


def agg_rollup(s, d):
    return _sales(s, d).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.grouping_id().cast("long").alias("gid"))


def agg_cube(s, d):
    return _sales(s, d).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.grouping_id().cast("long").alias("gid"))


def agg_grouping_sets(s, d):
    c, f = F.col("l_returnflag"), F.col("l_linestatus")
    return _sales(s, d).groupingSets([(c,), (f,)], c, f).agg(F.count("*").alias("n"), F.sum("q").alias("total"))


def window_frames(s, d):
    o = T.attempts(s, d)
    w = Window.partitionBy("user_id").orderBy("started_at", "attempt_id")
    return o.select("attempt_id", F.lag("attempt_id").over(w).alias("before"), F.lead("attempt_id").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), round_half_up(F.avg("price").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("status")).alias("rank"))


def set_intersect(s, d):
    return T.attempts(s, d).select("user_id").intersect(T.scan(s, d, "events").select("user_id"))


def set_except(s, d):
    return T.users(s, d).select("user_id").subtract(T.scan(s, d, "events").select("user_id"))


def approx_distinct(s, d):
    """Distinct users per type, exact and by sketch: whether the sketch is within 10 %.

    Users are made distinct first, which changes no sketch: beside a count of distinct users, each user would have one of 6.5 KB.
    """
    users = T.scan(s, d, "events").select("event_type", "user_id").distinct()
    g = users.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return g.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= F.col("users") * 0.1).alias("near"))


NAMES = [join_outer, join_semi, join_anti, join_range, join_asof, agg_rollup, agg_cube, agg_grouping_sets, window_frames, set_intersect, set_except, approx_distinct]
QUERIES = {f.__name__: f for f in NAMES}

_SALES = "FROM (SELECT l_returnflag, l_linestatus, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem)"
ORACLES = {
    "join_outer": "SELECT coalesce(a.user_id, e.user_id) AS user_id, attempts, events FROM (SELECT o_custkey AS user_id, count(*) AS attempts FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY 1) e ON e.user_id = a.user_id",
    "join_semi": "SELECT c_custkey AS user_id, c_nationkey AS class_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events)",
    "join_anti": "SELECT c_custkey AS user_id, c_nationkey AS class_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "join_range": "SELECT n_nationkey AS band, count(*) AS n, min(event_id) AS first FROM events JOIN nation ON value >= n_nationkey * 10.0::DOUBLE AND value < n_nationkey * 10.0::DOUBLE + 12 GROUP BY 1",
    "join_asof": "SELECT p.event_id, p.user_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts",
    "agg_rollup": f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, grouping_id(l_returnflag, l_linestatus) AS gid {_SALES} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, grouping_id(l_returnflag, l_linestatus) AS gid {_SALES} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(q) AS BIGINT) AS total {_SALES} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))",
    "window_frames": T.sql(
        """SELECT attempt_id, lag(attempt_id) OVER w AS before, lead(attempt_id) OVER w AS after, CAST(ntile(4) OVER w AS INT) AS quarter, floor(avg(price) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 100 + 0.5) / 100 AS moving,
  CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY status) AS INT) AS rank FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY started_at, attempt_id)""", "attempts"),
    "set_intersect": "SELECT o_custkey AS user_id FROM orders INTERSECT SELECT user_id FROM events",
    "set_except": "SELECT c_custkey AS user_id FROM customer EXCEPT SELECT user_id FROM events",
    "approx_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1",
}
