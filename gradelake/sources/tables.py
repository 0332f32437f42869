"""Tables: explicit schemas, scans, and the assessment tables that are laid over the driver's data.

Every loader only names columns, so that filters and projections reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: DDL of each stored table: streams need it, batch reads take it from the footers of the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; timestamps are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, user_id, assignment_id (year * 100 + quarter), status, started_at, price."""
    o = scan(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "GRADED").when(F.col("o_orderstatus") == "O", "SUBMITTED").otherwise("IN_PROGRESS")
    return o.select(
        F.col("o_orderkey").alias("attempt_id"),
        F.col("o_custkey").alias("user_id"),
        (F.year("o_orderdate") * 100 + F.quarter("o_orderdate")).alias("assignment_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_totalprice").alias("price"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per (attempt_id, question_id): the latest of those stored.

    is_correct is three-valued (null: not graded), and so is earned.  The latest is a
    grouped maximum over a struct, which combines before the shuffle.
    """
    li = scan(spark, sf_dir, "lineitem")
    rest = ["l_shipdate", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    last = li.groupBy(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id")).agg(F.max(F.struct(*rest)).alias("a"))
    ok = F.when(F.col("a.l_returnflag") == "N", True).when(F.col("a.l_returnflag") == "R", False)
    earned = F.when(F.col("a.l_returnflag") != "A", F.col("a.l_quantity") * (1 - F.col("a.l_discount")))
    return last.select("attempt_id", "question_id", ok.alias("is_correct"), earned.alias("earned"), F.lit(50.0).alias("score"), F.col("a.l_shipdate").alias("answered_at"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, kp_id, type, difficulty (0..1), link weight and the decay rate of the knowledge point."""
    p = scan(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("kp_id"), F.col("p_type").alias("type"), (F.col("p_size") / 50.0).alias("difficulty"), F.lit(1.0).alias("weight"), F.lit(0.001).alias("decay_rate")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, name, class_id, balance, segment."""
    c = scan(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("class_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id, class_name, tenant_id."""
    n = scan(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"), F.col("n_regionkey").alias("tenant_id"))


def grade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, subject_code, exam_name, exam_date, grade 0..15, source."""
    o = scan(spark, sf_dir, "orders")
    source = F.element_at(F.array(*[F.lit(x) for x in ("INTERNAL_MOCK", "EXTERNAL_MOCK", "OFFICIAL_GSAT")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("subject_code"), F.col("o_orderkey").cast("string").alias("exam_name"),
        F.col("o_orderdate").alias("exam_date"), F.least(F.lit(15), F.floor(F.col("o_totalprice") / 31250)).cast("int").alias("grade"), source.alias("source"),
    )


def wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wishes a user: user_id, percentile (0, 100], institution, star_group 1..8, wish_rank.

    The percentile is the share of users of the class with a balance no higher.
    """
    u = users(spark, sf_dir).join(classes(spark, sf_dir), "class_id")
    pct = F.cume_dist().over(Window.partitionBy("class_id").orderBy("balance")) * 100
    base = u.select("user_id", "class_id", "class_name", pct.alias("percentile"))
    named = classes(spark, sf_dir).select(F.col("class_id").alias("inst_id"), F.col("class_name").alias("institution"))
    ranked = base.withColumn("wish_rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    ranked = ranked.withColumn("inst_id", ((F.col("class_id") + (F.col("wish_rank") - 1) * 7) % 25).cast("int"))
    group = ((F.col("user_id") + F.col("wish_rank") - 1) % 8 + 1).cast("int")
    return ranked.join(named, "inst_id").select("user_id", "percentile", "institution", group.alias("star_group"), "wish_rank")


def proctor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id ("user-day"), user_id, type, at, duration_ms, event_id."""
    e = scan(spark, sf_dir, "events")
    kinds = {"view": "TAB_VISIBLE", "click": "WINDOW_FOCUS", "error": "FULLSCREEN_EXIT", "signup": "FULLSCREEN_ENTER", "purchase": "PASTE"}
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("event_type")]
    day = F.date_format("ts", "yyyyMMdd")
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), day).alias("attempt_id"), "user_id", kind.alias("type"), F.col("ts").alias("at"), (F.col("value") * 100).cast("long").alias("duration_ms"), "event_id")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assignment_id, paper_id, open_at, due_at (null for every fifth), policy, released_at (null for odd ones)."""
    a = attempts(spark, sf_dir).select("assignment_id").distinct()
    year, quarter = F.floor(F.col("assignment_id") / 100).cast("int"), F.col("assignment_id") % 100
    opened = F.make_timestamp(year, ((quarter - 1) * 3 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    due = F.when(F.col("assignment_id") % 5 != 0, opened + F.expr("INTERVAL 3 MONTHS"))
    policy = F.element_at(F.array(*[F.lit(x) for x in ("IMMEDIATE", "ON_SUBMIT", "ON_DUE", "MANUAL", "NEVER")]), (year % 5 + 1).cast("int"))
    released = F.when(F.col("assignment_id") % 2 == 0, opened + F.expr("INTERVAL 4 MONTHS"))
    return a.select("assignment_id", (F.col("assignment_id") % 6).alias("paper_id"), opened.alias("open_at"), due.alias("due_at"), policy.alias("policy"), released.alias("released_at"))


def for_tenant(df: DataFrame, tenant_id, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; without a tenant nothing matches (closed by default)."""
    return df.where(F.lit(False)) if tenant_id is None else df.where(F.col(column) == tenant_id)


def for_tenant_through(df: DataFrame, parent: DataFrame, key: str, tenant_id) -> DataFrame:
    """Child rows whose parent belongs to the tenant (EXISTS)."""
    return df.join(for_tenant(parent, tenant_id).select(key), key, "left_semi")


#: The same tables for DuckDB, to stand in front of an oracle's SELECT.
CTES = {
    "attempts": """attempts AS (SELECT o_orderkey AS attempt_id, o_custkey AS user_id, CAST(year(o_orderdate) * 100 + quarter(o_orderdate) AS INT) AS assignment_id,
  CASE o_orderstatus WHEN 'F' THEN 'GRADED' WHEN 'O' THEN 'SUBMITTED' ELSE 'IN_PROGRESS' END AS status, o_orderdate AS started_at, o_totalprice AS price FROM orders)""",
    "answers": """answers AS (SELECT l_orderkey AS attempt_id, l_partkey AS question_id, CASE l_returnflag WHEN 'N' THEN true WHEN 'R' THEN false END AS is_correct,
  CASE WHEN l_returnflag <> 'A' THEN l_quantity * (1 - l_discount) END AS earned, 50.0::DOUBLE AS score, l_shipdate AS answered_at FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)""",
    "questions": "questions AS (SELECT p_partkey AS question_id, p_brand AS kp_id, p_type AS type, p_size / 50.0::DOUBLE AS difficulty, 1.0::DOUBLE AS weight, 0.001::DOUBLE AS decay_rate FROM part)",
    "users": "users AS (SELECT c_custkey AS user_id, c_name AS name, c_nationkey AS class_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer)",
    "classes": "classes AS (SELECT n_nationkey AS class_id, n_name AS class_name, n_regionkey AS tenant_id FROM nation)",
    "grade_records": """grade_records AS (SELECT o_custkey AS user_id, o_orderpriority AS subject_code, CAST(o_orderkey AS VARCHAR) AS exam_name, o_orderdate AS exam_date,
  CAST(least(15, floor(o_totalprice / 31250)) AS INT) AS grade, (['INTERNAL_MOCK', 'EXTERNAL_MOCK', 'OFFICIAL_GSAT'])[o_orderkey % 3 + 1] AS source FROM orders)""",
    "wishes": """wishes AS (SELECT user_id, percentile, c2.n_name AS institution, CAST((user_id + wish_rank - 1) % 8 + 1 AS INT) AS star_group, CAST(wish_rank AS INT) AS wish_rank FROM
  (SELECT c_custkey AS user_id, c_nationkey, 100 * cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS percentile FROM customer) u
  CROSS JOIN (SELECT unnest([1, 2, 3]) AS wish_rank) JOIN nation c2 ON c2.n_nationkey = (u.c_nationkey + (wish_rank - 1) * 7) % 25)""",
    "assignments": """assignments AS (SELECT assignment_id, assignment_id % 6 AS paper_id, open_at, CASE WHEN assignment_id % 5 <> 0 THEN open_at + INTERVAL 3 MONTHS END AS due_at,
  (['IMMEDIATE', 'ON_SUBMIT', 'ON_DUE', 'MANUAL', 'NEVER'])[assignment_id // 100 % 5 + 1] AS policy, CASE WHEN assignment_id % 2 = 0 THEN open_at + INTERVAL 4 MONTHS END AS released_at
  FROM (SELECT DISTINCT assignment_id, make_timestamp(assignment_id // 100, (assignment_id % 100 - 1) * 3 + 1, 1, 0, 0, 0) AS open_at FROM attempts))""",
    "proctor_events": """proctor_events AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS attempt_id, user_id,
  CASE event_type WHEN 'view' THEN 'TAB_VISIBLE' WHEN 'click' THEN 'WINDOW_FOCUS' WHEN 'error' THEN 'FULLSCREEN_EXIT' WHEN 'signup' THEN 'FULLSCREEN_ENTER' WHEN 'purchase' THEN 'PASTE' END AS type,
  ts AS seen, CAST(trunc(value * 100) AS BIGINT) AS duration_ms, event_id FROM events)""",
}


def sql(body: str, *tables: str, extra: str = "") -> str:
    """An oracle: the named tables as common expressions, then ``extra`` ones, then the body."""
    parts = [CTES[t] for t in tables] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
