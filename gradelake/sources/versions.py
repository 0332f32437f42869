"""A table whose parts are replaced as a whole: a commit protocol over plain Parquet folders.

A version holds new rows and the list of parts (say pages of a document) that it replaces.  Both are written, then a
marker makes the version count; a writer that is lost before the marker leaves nothing that a reader sees, and
running it again starts over.  A part's rows are those of the last version that lists it, so that a part may also become empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    """The versions that count, from the oldest."""
    at, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))


def replace_parts(rows: DataFrame, parts: DataFrame, path: str, version: int, stop_before_commit: bool = False) -> None:
    """Writes ``version``: ``rows`` take the place of what the parts in ``parts`` (its columns are the key; every row's key is among them) held before.

    Writing a version again replaces it as a whole.  ``stop_before_commit`` leaves it as a lost writer would (for tests).
    """
    spark = rows.sparkSession
    delete(spark, f"{path}/done-{version}")
    rows.write.mode("overwrite").parquet(f"{path}/rows-{version}")
    parts.distinct().write.mode("overwrite").parquet(f"{path}/parts-{version}")
    if not stop_before_commit:
        at, fs = _fs(spark, f"{path}/done-{version}")
        fs.create(at, True).close()


def current(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The rows that stand: each part's as of the last committed version that replaced it."""
    rows = parts = None
    for v in committed(spark, path):
        r = spark.read.schema(schema).parquet(f"{path}/rows-{v}").withColumn("_version", F.lit(v))
        p = spark.read.parquet(f"{path}/parts-{v}").select(*keys).withColumn("_version", F.lit(v))
        rows, parts = (r, p) if rows is None else (rows.unionByName(r), parts.unionByName(p))
    if rows is None:
        return spark.createDataFrame([], schema)
    last = parts.groupBy(*keys).agg(F.max("_version").alias("_version"))
    return rows.join(last, [*keys, "_version"], "left_semi").drop("_version")


def vacuum(spark: SparkSession, path: str, schema, keys: list[str], version: int) -> None:
    """Makes ``version`` (above all others) of what stands, then deletes the versions before it."""
    old = committed(spark, path)
    now = current(spark, path, schema, keys)
    replace_parts(now, now.select(*keys), path, version)
    delete(spark, *[f"{path}/done-{v}" for v in old if v < version], *[f"{path}/{kind}-{v}" for v in old if v < version for kind in ("rows", "parts")])
