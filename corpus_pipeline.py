"""A corpus pipeline of five operators; each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Rows with null or empty texts go through every
stage (the classifier judges them like any other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import Scratch, table
from gradelake.llm.minhash_dedup import keep_one
from gradelake.llm.packing import pack
from gradelake.llm.quality import keep_good
from gradelake.llm.secret_scan import redact
from gradelake.llm.suffix_dedup import remove_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of least id, of each group (five-word shingles, similarity 0.8 or more)."""
    return keep_one(docs, k=5, num=80, den=100)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that occur more than once."""
    return _counted(remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets and linked parts of credentials."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of every document into sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: MinHash, the classifier and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's rows written before the next one reads them."""
    s = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = s.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
