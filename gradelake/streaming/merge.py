"""Tables that a stream keeps up to date: the latest row of each key, whatever batch is repeated.

Each micro-batch leaves its own latest rows in a folder named by its id and overwrites it when it runs again, so a
repeated batch changes nothing and a trigger's work grows with the batch, not with the table.  Reading takes the
latest of all folders; ``compact`` makes one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _latest(rows: DataFrame, keys: list[str], version: str, first: bool = False) -> DataFrame:
    pick = F.min_by if first else F.max_by
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def _folders(spark: SparkSession, path: str) -> dict[tuple[str, int], str]:
    """Finished folders by (kind, batch id): ``batch`` or ``compact``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    if fs.exists(at):
        for f in fs.listStatus(at):
            kind, _, number = f.getPath().getName().partition("-")
            if kind in ("batch", "compact") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out[kind, int(number)] = f.getPath().toString()
    return out


def keep_latest(path: str, keys: list[str], version: str, first: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch to the table at ``path``: of each key the row of greatest ``version`` counts (with ``first`` the least, as for claims).

    Equal versions are told apart by the other columns, so that the outcome does not depend on the order of rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        _latest(batch, keys, version, first).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    return run


def merged(spark: SparkSession, path: str, schema, keys: list[str], version: str, first: bool = False) -> DataFrame:
    """The table that ``keep_latest`` keeps; empty before the first batch."""
    found = _folders(spark, path)
    base = max((n for kind, n in found if kind == "compact"), default=-1)
    use = [p for (kind, n), p in found.items() if (kind, n) == ("compact", base) or kind == "batch" and n > base]
    rows = spark.read.schema(schema).parquet(*use) if use else spark.createDataFrame([], schema)
    return _latest(rows, keys, version, first).select(*rows.columns)


def compact(spark: SparkSession, path: str, schema, keys: list[str], version: str, through: int, first: bool = False) -> None:
    """Makes one folder of all batches up to ``through`` (all of which have ended for good), then deletes those; safe to repeat at any point."""
    from ..sources.shared import delete

    found = _folders(spark, path)
    if ("compact", through) not in found:
        base = max((n for kind, n in found if kind == "compact"), default=-1)
        use = [p for (kind, n), p in found.items() if (kind, n) == ("compact", base) or kind == "batch" and base < n <= through]
        if not use:
            return
        _latest(spark.read.schema(schema).parquet(*use), keys, version, first).write.mode("overwrite").parquet(f"{path}/compact-{through}")
    delete(spark, *[p for (kind, n), p in found.items() if kind == "batch" and n <= through or kind == "compact" and n < through])


def answered_gap(local: str, server: str, unsent: str):
    """ok, pending (the difference waits to be sent), lost or unknown: answers here against answers that arrived."""
    gap = F.col(local) - F.col(server)
    return F.when(gap.isNull(), "unknown").when(gap <= 0, "ok").when(gap <= F.coalesce(F.col(unsent), F.lit(0)), "pending").otherwise("lost")
