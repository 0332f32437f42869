"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Lengths are integers up to the sequence length, so best-fit decreasing needs no
per-document state: all pieces of one length are placed together, and the open
bins are kept as runs of bins with one remaining capacity.  A segment tree over the
capacities finds the tightest open one in logarithmic time.  The plan is made from the histogram of
lengths (at most ``size`` rows) and has a few rows a length; pieces find their
place by their rank among the pieces of their length, so nothing that grows with
the corpus passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table
from .tokens import document_bpe

SIZE = 1024
END = 2


class CapacityTree:
    """A segment tree over capacities 0..size: which have open bins, and the least such at or above a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.runs = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        i = capacity + self.leaves
        while i:
            self.runs[i] += change
            i //= 2

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.runs[i]:
            return least
        while i > 1:  # up to the first right sibling with open bins, then down its left-most path
            if i % 2 == 0 and self.runs[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.runs[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset): best-fit decreasing over a histogram.

    The piece of rank r >= first rank goes to bin ``first bin + (r - first rank) //
    pieces`` at ``offset + (r - first rank) % pieces * length``.
    """
    tree = CapacityTree(size)
    open_: dict[int, list[list[int]]] = {}  # runs [first bin, bins] by capacity
    bins, plan = 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append([first, n])
            tree.add(capacity, 1)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, each = size, size // length
                first, have = bins, -(-left // each)
                bins += have
            else:
                each = capacity // length
                run = open_[capacity][-1]
                first, have = run[0], min(run[1], -(-left // each))
                run[0] += have
                run[1] -= have
                if not run[1]:
                    open_[capacity].pop()
                    tree.add(capacity, -1)
            plan.append((length, rank, each, first, size - capacity))
            placed = min(left, have * each)
            full, part = divmod(placed, each)
            put(capacity - each * length, first, full)
            put(capacity - part * length, first + full, have - full)
            rank += placed
            left -= placed
    return np.array(plan, np.int64).reshape(-1, 5)


def _pieces(path: str | None, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_bpe(path)
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids), 500):
                out: list[list] = [[] for _ in range(6)]
                known: dict[str, list] = {}
                for doc, text in zip(ids[lo : lo + 500], texts.slice(lo, 500).to_pylist(), strict=True):
                    text = text or ""
                    if text not in known:
                        t = np.append(encode(text), np.uint32(end)).astype("<u4")
                        first = len(t) % size or size
                        cuts = [0, *range(first, len(t) + 1, size)]
                        known[text] = [(a, b - a, zlib.crc32(t[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]
                    for k, (a, n, crc) in enumerate(known[text]):
                        for o, v in zip(out, (doc, k, a, n, crc, seen[n]), strict=True):
                            o.append(v)
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                cols = [pa.array(o, k) for o, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(out[0]), task, np.int32))], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return run


def _place(plan: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] << 44 | plan[:, 1]  # lengths fall, ranks rise: sort once
        order = np.argsort(key)
        key, rows = key[order], plan[order]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            step = rank - r[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(r[:, 3] + step // r[:, 2]), pa.array(r[:, 4] + step % r[:, 2] * length)], names=[*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, size: int = SIZE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of ``size`` tokens.

    docs: doc_id (long) and text; other columns are not read.  A document is its
    token ids and ``end``; a longer one than ``size`` is cut into full pieces after a
    shorter first one.  Returns per piece doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.  The string of an added token in a text is that token.
    A null or empty text is the ``end`` token alone; repeated rows are packed each; null ids stay null; an empty table gives an empty result.
    """
    s = Scratch(docs.sparkSession, "packing")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int"
    pieces = s.save(d.mapInArrow(_pieces(tokenizer, size, end), kind), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = s.save(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    plan = best_fit_plan({r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    ranked = pieces.join(base.select("task", "length", "base"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(plan), out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
