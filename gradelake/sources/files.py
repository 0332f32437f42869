"""Files from outside: CSV in several encodings, header matching, file kinds, partition-wise and idempotent writes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding) by byte-order mark, else strict UTF-8, else Big5 with replacement characters."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace"), "utf-8-bom"
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace"), "utf-16le"
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace"), "utf-16be"
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("big5", "replace"), "big5"


def rows_of(text: str) -> Iterator[tuple[int, list[str]]]:
    """(row number from 1, cells) of a CSV text with quotes and any line ends; rows of blank cells are passed over."""
    for n, row in enumerate(csv.reader(io.StringIO(text, newline="")), 1):
        if any(c.strip() for c in row):
            yield n, row


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "encoding": pa.string(), "line": pa.int64(), "cells": pa.list_(pa.string())}
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            text, encoding = decode(raw or b"")
            out: list[tuple] = []
            for n, cells in rows_of(text):
                out.append((path, encoding, n, cells))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, line, cells) of uploaded CSV files, whatever their encoding; files are dealt out to tasks.

    Each file is read whole by one task, as an upload's encoding is known only from all of
    it; big UTF-8 exports go through ``read_csv``, which splits them.
    """
    return parse_tables(spark.read.format("binaryFile").load(path).select("path", "content"))


def parse_tables(files: DataFrame) -> DataFrame:
    """The same from a table of uploads (path, content)."""
    return files.select("path", "content").mapInArrow(_parse, "path string, encoding string, line long, cells array<string>")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, multiline: bool = False) -> DataFrame:
    """Large UTF-8 CSV with a stated schema; rows that do not parse keep their text in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("header", header).option("multiLine", multiline).option("quote", '"').option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def normal_header(name: Column) -> Column:
    """Without a byte-order mark, white space and what stands in parentheses, in lower case."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\x{FEFF}", ""), r"[\s\x{3000}]", "")
    return F.lower(F.regexp_replace(t, "[（(].*?[)）]", ""))


def named_columns(tables: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(path, line, <field> ...) from ``read_tables``: each field is the first column of the file's first row that one of its names fits."""
    head = tables.groupBy("path").agg(F.min_by("cells", "line").alias("head"), F.min("line").alias("first"))
    names = F.transform("head", normal_header)

    def place(options: list[str]) -> Column:
        fits = F.array(*[normal_header(F.lit(o)) for o in options])
        return F.array_position(F.transform(names, lambda h: F.array_contains(fits, h)), True)

    at = {field: place(options) for field, options in aliases.items()}
    head = head.select("path", "first", *[F.when(p > 0, p).cast("int").alias(f"_{f}") for f, p in at.items()])
    body = tables.join(head, "path").where(F.col("line") > F.col("first"))
    return body.select("path", "line", *[F.trim(F.try_element_at("cells", F.col(f"_{f}"))).alias(f) for f in aliases])


#: The first bytes (hexadecimal) of known kinds of file.
MAGIC = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "zip": "504B0304"}


def file_kind(content: Column) -> Column:
    """The kind of a file by its first bytes: pdf, png, jpeg, gif, webp, zip (as docx is), else unknown."""
    start = F.hex(F.substring(content, 1, 12))
    out = F.when(F.startswith(start, F.lit("52494646")) & (F.substring(start, 17, 8) == "57454250"), "webp")
    for kind, magic in MAGIC.items():
        out = out.when(F.startswith(start, F.lit(magic)), kind)
    return out.otherwise("unknown")


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes the partitions that ``df`` holds anew and leaves the others: running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
