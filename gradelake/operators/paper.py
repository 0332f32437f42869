"""Papers: spreading scores, option order, seeded layouts and where questions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread_scores(items: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """Each paper's total over its items in the largest unit of 1, 0.5 and 0.01 that divides it; the remainder goes to the last items."""
    w = Window.partitionBy(key)
    r = items.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(order)))
    r = r.withColumn("want", F.floor(F.col(total) * 100 + 0.5) / 100)
    unit = F.lit(0.01)
    for u in (0.5, 1.0):
        parts = F.col("want") / u
        unit = F.when((F.abs(parts - F.floor(parts + 0.5)) < 1e-9) & (F.floor(parts + 0.5) >= F.col("n")), u).otherwise(unit)
    r = r.withColumn("unit", unit).withColumn("units", F.floor(F.col("want") / F.col("unit") + 0.5)).withColumn("base", F.floor(F.col("units") / F.col("n")))
    extra = F.when(F.col("i") > F.col("n") - (F.col("units") - F.col("base") * F.col("n")), 1).otherwise(0)
    return r.select(*items.columns, F.when(F.col("want") == 0, 0.0).otherwise(F.floor((F.col("base") + extra) * F.col("unit") * 100 + 0.5) / 100).alias("score"))


def normalize_options(options: Column, keys: Column) -> tuple[Column, Column, Column, Column]:
    """(options, keys, dropped, duplicates): blank options go, the rest is numbered anew by order, and keys follow.

    options: array<struct<order, label, content>>; an option without an order has its place.
    ``duplicates`` holds the labels whose content (white space folded) an earlier option has.
    """
    placed = F.transform(options, lambda o, i: F.struct(F.coalesce(F.nullif(o["order"], F.lit(0)), i + 1).alias("order"), i.alias("at"), o["label"].alias("label"), F.trim(F.coalesce(o["content"], F.lit(""))).alias("content")))
    kept = F.array_sort(F.filter(placed, lambda o: o["content"] != ""))
    fresh = F.transform(kept, lambda o, i: F.struct((i + 1).alias("order"), F.coalesce(o["label"], o["order"].cast("string")).alias("label"), o["content"].alias("content")))
    orders = F.transform(kept, lambda o: o["order"])
    to = F.transform(keys, lambda k: F.array_position(orders, k).cast("int"))
    folded = F.transform(kept, lambda o: F.regexp_replace(o["content"], r"\s+", " "))
    again = F.filter(F.transform(fresh, lambda o, i: F.when(F.array_position(folded, F.regexp_replace(o["content"], r"\s+", " ")) <= i, o["label"])), lambda x: x.isNotNull())
    return fresh, F.array_sort(F.filter(to, lambda k: k > 0)), F.filter(keys, lambda k: ~F.array_contains(orders, k)), again


def layout(items: DataFrame, attempt: str, block: str, order: str, seed: int) -> DataFrame:
    """Positions of a shuffled paper that keeps the questions of a block together; one seed gives one layout."""
    key = F.xxhash64(F.lit(seed), F.col(attempt), F.col(block))
    nth = F.row_number().over(Window.partitionBy(attempt).orderBy(key, block, order))
    return items.withColumn("position", nth)


def usage(items: DataFrame, question: str, paper: str, limit: int = 3) -> DataFrame:
    """Per question: distinct papers, the first ``limit`` of them and how many more there are."""
    g = items.groupBy(question).agg(F.array_sort(F.collect_set(paper)).alias("all"))
    return g.select(question, F.size("all").cast("long").alias("papers"), F.array_join(F.slice("all", 1, limit).cast("array<string>"), ",").alias("first"), F.greatest(F.size("all") - limit, F.lit(0)).cast("long").alias("more"))


def pace(sittings: DataFrame, key: str, seconds: str, questions: str, target: int = 50) -> DataFrame:
    """Seconds a question and the projection to ``target`` questions in minutes; null without any question."""
    g = sittings.groupBy(key).agg(F.sum(seconds).alias("s"), F.sum(questions).alias("n"))
    each = F.col("s") / F.nullif("n", F.lit(0))
    return g.select(key, "n", (F.floor(each * 100 + 0.5) / 100).alias("seconds_each"), (F.floor(each * target / 60 * 10 + 0.5) / 10).alias("minutes_to_target"))
