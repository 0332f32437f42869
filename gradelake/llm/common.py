"""Shared plumbing of the corpus operators: tables, scratch space, components.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (a folder that
all executors share), never by ``localCheckpoint``; a lost executor only means
that a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, new_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one query, kept in the shared folder.

    ``save`` runs a plan, writes it and reads it back, so that later steps start
    from stored rows; the shuffle files of that plan are released when it ends.
    ``drop`` deletes tables that no later step reads, ``clear`` all of them.  What a lazy result still reads goes with the
    ``gradelake.sources.shared.scope`` that it was asked for in, or when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = new_path(spark, label)
        self.made = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        delete(self.spark, *[df._scratch_path for df in frames])

    def clear(self) -> None:
        delete(self.spark, self.root)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that clashes with none of ``df`` (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that tell rows apart even where ids repeat or are null.

    Rows with one id and one text share the key; they get the same result.  Rows with
    null ids are told apart by 128 bits of their text, rows that repeat an id by 64.
    """
    null, text = F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("id"), text)).alias("kd"), F.xxhash64(null, text).alias("kt")]


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Connected components as ``(id, comp)``, ``comp`` the smallest id of each.

    Rounds of contraction: each vertex points to the least of its neighbours and itself, a pointer
    jump shortens the chains, and edges are redrawn between what they point to.  Least is the
    smallest id in every other round, which settles stars at their hubs, and the smallest hash of id and round in
    the rounds between, so that a chain shrinks by a constant share whatever its ids are.  Every step is a grouped
    minimum with map-side combine or an equi-join with a unique side; the driver only learns whether
    edges are left.  Rows with a null end are ignored.  Empty input gives an empty result.
    """

    def ordered(e: DataFrame) -> DataFrame:
        e = e.where("a <> b")
        return scratch.save(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    e = ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    steps: list[DataFrame] = []
    for i in range(max_rounds):
        place = lambda c, i=i: F.struct((F.xxhash64(F.lit(i), F.col(c)) if i % 2 else F.lit(0)).alias("h"), F.col(c).alias("p"))
        near = e.union(e.select("b", "a")).groupBy(F.col("a").alias("v")).agg(F.min(place("b")).alias("low"))
        near = scratch.save(near.select("v", F.least("low", place("v"))["p"].alias("p")), "near")
        up = near.select(F.col("v").alias("w"), F.col("p").alias("q"))
        to = scratch.save(near.join(up, near.p == up.w).select("v", F.col("q").alias("p")), "points")
        scratch.drop(near)
        steps.append(to)
        at_a, at_b = to.select(F.col("v").alias("va"), F.col("p").alias("pa")), to.select(F.col("v").alias("vb"), F.col("p").alias("pb"))
        left = ordered(e.join(at_a, e.a == at_a.va).join(at_b, e.b == at_b.vb).select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        scratch.drop(e)
        e = left
        if e.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = steps[-1]
    for to in steps[-2::-1]:
        top = labels.select(F.col("v").alias("w"), F.col("p").alias("q"))
        labels = scratch.save(to.join(top, to.p == top.w, "left").select("v", F.coalesce("q", "p").alias("p")), "labels")
    least = labels.groupBy(F.col("p").alias("root")).agg(F.min("v").alias("comp"))
    return scratch.save(labels.join(least, labels.p == least.root).select(F.col("v").alias("id"), "comp"), "least")
