"""Stored event files as streams, and a run-to-the-end helper for tests, queries and catch-up jobs."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path
from ..sources.tables import SCHEMAS


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; files that are added later are read by later triggers."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(sf_dir)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Runs a stream over what is there, then stops; append mode goes to Parquet files in the shared folder.

    With other modes the last table is what counts, and each trigger overwrites it.  ``rocksdb`` sets the state store that ``transformWithState`` needs.
    """
    spark = df.sparkSession
    root = new_path(spark, "stream")
    w = df.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        w = w.outputMode("append").format("parquet").option("path", f"{root}/out")
    else:
        w = w.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out"))
    before = spark.conf.get(_PROVIDER)
    if rocksdb:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        w.start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(df.schema).parquet(f"{root}/out")


#: Rows that one file of a replayed table holds, about.
FILE_ROWS = 250_000


def replayed(rows: DataFrame, order: str, parts: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stored table as a stream of ``parts`` triggers, by quantiles of ``order``, written one after the other.

    Every trigger reads the same number of files, so that large ones are written and read by several tasks.
    """
    spark = rows.sparkSession
    path = new_path(spark, "replay")
    cuts = rows.select(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("q")).first()["q"] or []
    spans = [[F.col(order) > lo] * (lo is not None) + [F.col(order) <= hi] * (hi is not None) for lo, hi in zip([None, *cuts], [*cuts, None], strict=True)]
    inside = [functools.reduce(operator.and_, s, F.lit(True)) for s in spans]
    files = max(1, min(rows.select(*[F.count_if(x) for x in inside]).first()) // file_rows)
    for x in inside:
        part = rows.where(x)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
