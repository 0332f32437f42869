"""Packing of tokenised documents by non-negative least squares over length combinations.

Documents are cut into windows of ``size`` tokens and a shorter rest.  All combinations
of up to three rests that fill a window exactly are enumerated, and their repeat
counts are solved against the histogram of rest lengths (least squares, no count below zero), then rounded.  What they
leave over is packed greedily: deep combinations, largest first, as long as they
fill a window exactly, and the last rests are laid end to end and cut where a window ends, so that no token is
padding.  The last window is cut into powers of two, which need no padding either.

The plan is made on the driver from at most ``size`` numbers; its size follows ``size``,
never the corpus.  A piece finds its row of the plan by its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table
from .tokens import document_bpe

SIZE = 2048
END = 1
STEPS = 250


def combinations(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths, not falling, that add up to ``size``; 0 stands for no piece."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    have[0] = True
    rows = []
    for a in np.flatnonzero(have):
        b = np.arange(a, (size - a) // 2 + 1)
        c = size - a - b
        b, c = (x[have[b] & have[c] & (c >= b)] for x in (b, c))
        rows.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def solve_counts(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each combination: x >= 0 of least ``|A x - counts|``, A[length, combination] being how often it uses that length.

    Projected gradient with momentum, restarted where the sum of squares rises; every step is a gather and a sum over
    the combinations.
    """
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    goal = counts.astype(float)
    goal[0] = 0

    def used(v: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, k], v, len(goal)) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.ones(len(combos))
    for _ in range(12):
        v = back(used(v))
        top = np.sqrt(v @ v)
        v /= top
    rate = 1 / (1.1 * top)
    y, t, last = x, 1.0, np.inf
    for _ in range(steps):
        rest = used(y) - goal
        new = np.maximum(0, y - rate * back(rest))
        error = rest @ rest
        if error > last:
            t = 1.0
        last = error
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, new + (t - 1) / t_new * (new - x))
        x, t = new, t_new
    return x


def round_counts(combos: np.ndarray, x: np.ndarray, left: list[int]) -> list[tuple[list[int], int]]:
    """Whole repeat counts: each rounded down, then one more by the size of the part cut off, as far as pieces are left; ``left`` is reduced."""
    floor = np.floor(x + 1e-9)
    part = x - floor
    out = []
    for order, repeats in ((np.argsort(-x, kind="stable"), floor), (np.argsort(-part, kind="stable"), (part > 1e-6).astype(float))):
        for i in order:
            want = int(repeats[i])
            if not want:
                continue
            parts = [int(c) for c in combos[i] if c]
            times = min(want, *(left[c] // parts.count(c) for c in parts))
            if times:
                for c in parts:
                    left[c] -= times
                out.append((parts, times))
    return out


def greedy_fills(left: list[int], size: int) -> list[tuple[list[int], int]]:
    """Combinations of any depth, largest length first, that fill a window exactly, and how often; ``left`` is reduced to what none of them takes.

    Every step uses up a length or gives up the largest one, so there are at most a few times ``size`` steps.
    """
    out, given_up = [], {}
    lengths = [c for c in range(1, size + 1) if left[c]]
    while lengths:
        room, parts, times, at = size, [], None, len(lengths)
        while room and at:
            at = min(at, bisect_right(lengths, room))
            if not at:
                break
            c = lengths[at - 1]
            n = min(left[c], room // c)
            parts += [c] * n
            room -= n * c
            times = min(times or left[c], left[c] // n)
            at -= 1
        if room:
            given_up[lengths[-1]] = left[lengths[-1]]
            left[lengths.pop()] = 0
            continue
        out.append((parts, times))
        for c in parts:
            left[c] -= times
        lengths = [c for c in lengths if left[c]]
    for c, n in given_up.items():
        left[c] = n
    return out


def make_plan(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Plan rows (length, first rank, pieces a sequence, first sequence, offset, place), and the ends of the laid-out windows.

    ``place`` is -1 where pieces lie whole: the piece of rank r is in ``first sequence + s // pieces`` at ``offset + s % pieces *
    length`` with s = r - first rank.  Otherwise pieces are laid end to end from ``place`` on and cut at the ends: at every multiple
    of ``size`` up to the first end, then at the others; sequences count from ``first sequence``.
    """
    left = [0] * (size + 1)
    for c, n in counts.items():
        left[c] = n
    lengths = np.array([c for c in range(1, size + 1) if left[c]], int)
    combos = combinations(lengths, size)
    whole = round_counts(combos, solve_counts(combos, np.array(left)), left)
    whole += greedy_fills(left, size)
    taken = [0] * (size + 1)
    rows, sequences = [], 0
    for parts, times in whole:
        at = 0
        for c in sorted(set(parts), reverse=True):
            n = parts.count(c)
            rows.append((c, taken[c], n, sequences, at, -1))
            taken[c] += n * times
            at += n * c
        sequences += times
    place = 0
    for c in range(size, 0, -1):
        if left[c]:
            rows.append((c, taken[c], 1, sequences, 0, place))
            place += c * left[c]
    ends = [place // size * size]
    rest = place % size
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    plan = np.array(rows, np.int64).reshape(-1, 6)
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))], np.array(ends, np.int64)


def _pieces(path: str | None, size: int, end: int):
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary()), ("task", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_bpe(path)
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(docs), 500):
                rows: list[tuple] = []
                known: dict[str, np.ndarray] = {}
                for doc, text in zip(docs[lo : lo + 500], texts.slice(lo, 500).to_pylist(), strict=True):
                    text = text or ""
                    if (t := known.get(text)) is None:
                        t = np.append(encode(text), np.uint32(end))
                        t = known[text] = t.astype("<u2" if t.max() < 1 << 16 else "<u4")
                    for a in range(0, len(t), size):
                        part = t[a : a + size]
                        rows.append((doc, a, len(part), len(t), int(seen[len(part)]), part.tobytes(), task))
                        seen[len(part)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def _place(plan: np.ndarray, ends: np.ndarray, size: int):
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = plan[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - r[:, 1]
            sequence = np.where(r[:, 5] < 0, r[:, 3] + nth // r[:, 2], r[:, 3]).tolist()
            offset = (r[:, 4] + nth % r[:, 2] * length).tolist()
            place = np.where(r[:, 5] < 0, -1, r[:, 5] + nth * length).tolist()
            rows: list[tuple] = []
            cols = [batch.column(n).to_pylist() for n in ("doc_id", "start", "length", "doc_tokens", "ids")]
            for doc, start, n, total, ids, seq, off, at in zip(*cols, sequence, offset, place, strict=True):
                t = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                if at < 0:
                    rows.append((doc, start, n, t.tobytes(), total, seq, off))
                    continue
                done = 0
                while done < n:
                    p = at + done
                    if p < ends[0]:
                        number, first = divmod(p, size)
                        number, first, last = number, p - first, p - first + size
                    else:
                        k = int(np.searchsorted(ends, p, side="right"))
                        number, first, last = int(ends[0]) // size + k - 1, int(ends[k - 1]), int(ends[k])
                    m = min(n - done, last - p)
                    rows.append((doc, start + done, m, t[done : done + m].tobytes(), total, seq + number, p - first))
                    done += m
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def pack_windows(docs: DataFrame, size: int = SIZE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of at most ``size`` tokens.

    docs: doc_id (long) and text; other columns are not read.  A document is its token ids and ``end``; pieces are
    cut at multiples of ``size`` and where a laid-out window ends, and each id lies in exactly one.  Returns per piece doc_id, start, length,
    ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.  Sequences are full or, in the end, powers of two long.
    A null or empty text is the ``end`` token alone; repeated rows are packed each; null ids stay null; an empty table gives an empty result.
    Stored: one copy of the ids (2 bytes each where the vocabulary allows), which the one shuffle moves to their ranks.
    """
    s = Scratch(docs.sparkSession, "windows")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, start long, length long, doc_tokens long, nth long, ids binary, task int"
    pieces = s.save(d.mapInArrow(_pieces(tokenizer, size, end), kind), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = s.save(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    plan, ends = make_plan({r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    ranked = pieces.join(base.select("task", "length", "base").hint("shuffle_hash"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    out = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "rank").mapInArrow(_place(plan, ends, size), out)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_windows(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
