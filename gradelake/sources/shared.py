"""Stored intermediate tables in the folder that a cluster's driver and executors share.

Everything that one application stores lies in one folder, ``gradelake-<application id>``.  ``scope`` deletes what was
stored inside it, ``forget`` single tables, and what is left goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode where none is named (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gradelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder; the innermost ``scope`` deletes it."""
    root = f"{shared_dir(spark)}/gradelake-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(delete, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, those that are gone already or cannot be reached any more aside."""
    for path in paths:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end: write or collect a result within it.

        with scope(spark):
            QUERIES["graph_levels"](spark, folder).write.parquet(out)
    """
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        delete(spark, *mine)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of ``df``, written once and read back: later steps start from the table, so plans stay short and a lost executor costs a task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables of ``stored`` that no later step reads."""
    for df in frames:
        delete(df.sparkSession, df._stored_path)
