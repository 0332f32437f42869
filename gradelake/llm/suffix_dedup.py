"""Repeated byte windows of a corpus: depth-limited most-significant-digit passes.

The suffixes that start in every document are ordered only through ``window``
bytes, by digits from coarse to fine, and a suffix leaves as soon as it stands
alone in its group.  Digits are hashed pieces of those first ``window`` bytes:

1. the *minimiser gram* of the window (the least-hashed 48-byte piece in it);
   equal windows have equal grams at equal offsets, and about one suffix in 76
   is the first that owns its gram, so this digit is dealt out once for a run of
   neighbouring suffixes instead of once for each;
2. the whole stretch of text that such a run of suffixes covers;
3. cells of eight suffixes within it, where (2) stands alone; first by the bytes that
   all windows of the cell share;
4. single suffixes to the full depth, where (3) stands alone.

What is equal after the last digit that was needed is exactly the set of
repeated windows: equal stretches repeat every window in them, and stretches
that stand alone are refined down to single windows.  The identity is 128 bits
(gram and stretch hash together).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, doc_key, table
from .textbytes import CHUNK, Rolling, by_bytes, sliding_min, view

WINDOW = 200
GRAM = 48
#: Suffixes in one stretch of the third digit.
STRETCH = 8
_ITEM = "g1 long, g2 int, c long, kd long, kt long, start int, len int"


def _segments(off: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, from, to) of about CHUNK bytes; long rows are cut with ``window - 1`` bytes of overlap."""
    for lo, hi in by_bytes(off, CHUNK):
        if hi - lo == 1 and off[hi] - off[lo] > 2 * CHUNK:
            for at in range(0, int(off[hi] - off[lo]), CHUNK):
                yield [(lo, at, min(at + CHUNK + window - 1, int(off[hi] - off[lo])))]
        else:
            yield [(r, 0, int(off[r + 1] - off[r])) for r in range(lo, hi)]


def _anchors(window: int, gram: int):
    """Batches of (kd, kt, text) to items of the first two digits."""
    w = window - gram + 1
    low = np.uint64(0xFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column("text"))
            kd = batch.column("kd").to_numpy(zero_copy_only=False)
            kt = batch.column("kt").to_numpy(zero_copy_only=False)
            for group in _segments(off, window):
                at = off[[r for r, _, _ in group]] + np.array([a for _, a, _ in group])
                size = np.array([b - a for _, a, b in group])
                seg = raw[at[0] : at[-1] + size[-1]]  # rows of a batch lie side by side
                if len(seg) < window:
                    continue
                base = at - at[0]
                r = Rolling(seg)
                g = r.every(gram)
                least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), w)
                m = len(least)
                end = np.repeat(base + size, size)[:m]
                idx = np.flatnonzero(np.arange(m) + window <= end)
                if not len(idx):
                    continue
                own = (least[idx] & low).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                start, length = idx[first], np.diff(np.append(first, len(idx)))
                owner = own[first]
                # the stretch's place relative to its gram belongs to the digit
                c = r.of(start, start + length - 1 + window) ^ ((owner - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                k = np.searchsorted(base, start, side="right") - 1
                row = np.array([x[0] for x in group])[k]
                began = np.array([x[1] for x in group])[k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g[owner].view(np.int64)), pa.array((owner - start).astype(np.int32)), pa.array(c.view(np.int64)),
                        pa.array(kd[row]), pa.array(kt[row]), pa.array((start - base[k] + began).astype(np.int32)), pa.array(length.astype(np.int32)),
                    ],
                    names=["g1", "g2", "c", "kd", "kt", "start", "len"],
                )

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretch of text of each wanted item; ``text`` comes with its list of items."""
    for batch in batches:
        raw, off = view(batch.column("text"))
        rows = []
        for i, (kd, kt, items) in enumerate(zip(batch.column("kd").to_pylist(), batch.column("kt").to_pylist(), batch.column("items").to_pylist(), strict=True)):
            lo = int(off[i])
            for x in items:
                a = lo + x["start"]
                rows.append((x["g1"], x["g2"], kd, kt, x["start"], x["len"], x["w"], x["real"], raw[a : a + x["len"] - 1 + x["window"]].tobytes()))
            if len(rows) >= 20_000:
                yield _context_batch(rows)
                rows = []
        if rows:
            yield _context_batch(rows)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["g1", "g2", "kd", "kt", "start", "len", "w", "real", "ctx"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _core(start: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """What all windows of a cell have in common: its last window's start to its first one's end."""
    return start, start + window - (step - 1)


def _refine(window: int, step: int):
    """Contexts to items of ``step`` suffixes, cut at fixed distances from the gram.

    ``g2`` of a context is the gram's distance from its start; of an item, the
    number of the cell of ``step`` suffixes, counted from the gram, that it fills, and
    ``g1`` the hash of the bytes that all windows of that cell share: a cell whose shared
    bytes stand alone has no repeated window and leaves with its group of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column("ctx"))
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("g1", "g2", "kd", "kt", "start", "len", "w", "real")}
            for lo, hi in by_bytes(off, CHUNK):
                r = Rolling(raw[off[lo] : off[hi]])
                length, ahead = col["len"][lo:hi].astype(np.int64), col["g2"][lo:hi].astype(np.int64)
                row = np.repeat(np.arange(hi - lo), length)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                cell = (ahead[row] - inside) // step  # a suffix's distance from the gram, in cells
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]))
                size = np.diff(np.append(first, len(row)))
                row, inside, cell = row[first], inside[first], cell[first]
                at = off[lo:hi][row] - off[lo] + inside
                g1 = col["g1"][row + lo] if step == 1 else r.of(*_core(off[lo:hi][row] - off[lo] + ahead[row] - cell * step, window, step)).view(np.int64)
                c = r.of(at, at + size - 1 + window) ^ ((ahead[row] - inside).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                k = row + lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g1), pa.array(cell.astype(np.int32)), pa.array(c.view(np.int64)), pa.array(col["kd"][k]), pa.array(col["kt"][k]),
                        pa.array((col["start"][k] + inside).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(col["w"][k]), pa.array(col["real"][k]),
                        pa.array((ahead[row] - inside).astype(np.int32)), pa.array(col["g1"][k]),
                    ],
                    names=["g1", "g2", "c", "kd", "kt", "start", "len", "w", "real", "ahead", "gram"],
                )

    return run


def _digit(s: Scratch, items: DataFrame, name: str, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pass: (class table, real items whose class holds others too).

    items: g1, g2, c, kd, kt, start, len, w, real.  A stand-in for a class of
    several items has w = 2 and is not real.
    """
    keys = ["g1", "g2", "c"]
    cols = ["kd", "kt", "start", "len", "real", *extra]
    classes = s.save(items.groupBy(*keys).agg(F.sum("w").alias("n"), *[F.first(x).alias(x) for x in cols]), f"{name}-classes")
    many = s.save(classes.where("n >= 2").select(*keys), f"{name}-many")
    same = s.save(items.where("real").join(many, keys, "left_semi").select("kd", "kt", "start", "len"), f"{name}-same")
    s.drop(many)
    return classes, same


def _alone(s: Scratch, classes: DataFrame, name: str, group: list[str]) -> DataFrame:
    """Classes to refine: the single real ones that share a group with others, and one stand-in for each of those."""
    live = s.save(classes.groupBy(*group).agg(F.count("*").alias("m"), F.max(F.expr("n = 1 and real")).alias("open")).where("m >= 2 and open").select(*group), f"{name}-live")
    out = classes.join(live, group, "left_semi").select(*[c for c in classes.columns if c not in ("n", "c", "real")], F.least("n", F.lit(2)).cast("int").alias("w"), F.expr("n = 1 and real").alias("real"))
    return s.save(out, f"{name}-next")


def repeated_windows(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``(kd, kt, ranges)``: per document the runs ``{start, len}`` of window starts that occur elsewhere too.

    docs: kd, kt (see ``doc_key``) and text.  ``len`` counts starting positions,
    so a run covers ``len - 1 + window`` bytes.  Documents without any are absent.
    """
    s = scratch or Scratch(docs.sparkSession, "suffix")
    gram = min(GRAM, max(1, window // 4))
    found = s.save(docs.select("kd", "kt", "text").mapInArrow(_anchors(window, gram), _ITEM), "anchors")
    # digit 1: grams that stand alone leave at once
    grams = s.save(found.groupBy("g1").agg(F.count("*").alias("n")).where("n >= 2").select("g1"), "grams")
    items = s.save(found.join(grams, "g1", "left_semi").select(*found.columns, F.lit(1).alias("w"), F.lit(True).alias("real")), "shared")
    s.drop(found, grams)
    # digit 2: whole stretches; the gram's group stays the group of what stands alone
    classes, same2 = _digit(s, items, "stretch", [])
    s.drop(items)
    todo = _alone(s, classes, "stretch", ["g1"])
    s.drop(classes)
    want = todo.groupBy("kd", "kt").agg(F.collect_list(F.struct("g1", "g2", "start", "len", "w", "real", F.lit(window).alias("window"))).alias("items"))
    want = s.save(want, "wanted")
    context = s.save(
        docs.select("kd", "kt", "text").join(want, ["kd", "kt"]).mapInArrow(_contexts, "g1 long, g2 int, kd long, kt long, start int, len int, w int, real boolean, ctx binary"), "contexts"
    )
    s.drop(want, todo)
    # digit 3: stretches of STRETCH suffixes
    kind = "g1 long, g2 int, c long, kd long, kt long, start int, len int, w int, real boolean, ahead int, gram long"
    items = s.save(context.mapInArrow(_refine(window, STRETCH), kind), "cells")
    classes, same3 = _digit(s, items, "cell", ["ahead", "gram"])
    s.drop(items)
    todo = _alone(s, classes, "cell", ["g1", "g2"])
    s.drop(classes)
    # digit 4: single suffixes
    part = todo.select("gram", F.col("g1").alias("g0"), "kd", "kt", F.col("start").alias("s0"), F.col("len").alias("l0"), F.col("w").alias("w0"), F.col("real").alias("r0"), F.col("ahead").alias("a0"))
    within = context.select(F.col("g1").alias("gram"), "kd", "kt", "start", "len", "ctx")
    cut = within.join(part, ["gram", "kd", "kt"]).where("s0 >= start and s0 + l0 <= start + len")
    cut = cut.select(F.col("g0").alias("g1"), F.col("a0").alias("g2"), "kd", "kt", F.col("s0").alias("start"), F.col("l0").alias("len"), F.col("w0").alias("w"), F.col("r0").alias("real"), F.expr(f"substring(ctx, s0 - start + 1, l0 - 1 + {window})").alias("ctx"))
    items = s.save(cut.mapInArrow(_refine(window, 1), kind).drop("ahead", "gram"), "suffixes")
    s.drop(context, todo)
    classes, same4 = _digit(s, items, "suffix", [])
    s.drop(items, classes)
    every = same2.union(same3).union(same4)
    return every.groupBy("kd", "kt").agg(F.collect_list(F.struct("start", "len")).alias("ranges"))


def _runs(ranges: list[dict] | None, window: int) -> np.ndarray:
    """Maximal covered byte runs as rows of (start, end)."""
    if not ranges:
        return np.zeros((0, 2), np.int64)
    x = np.array([(r["start"], r["start"] + r["len"] - 1 + window) for r in ranges], np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > top[:-1]])
    first = np.flatnonzero(new)
    return np.stack([x[first, 0], top[np.append(first[1:], len(x)) - 1]], axis=1)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                doc = raw[off[i] : off[i + 1]]
                runs = _runs(ranges, window)
                kept, at = [], 0
                for a, b in runs.tolist():
                    kept.append(doc[at:a].tobytes())
                    at = b
                kept.append(doc[at:].tobytes())
                digest = hashlib.sha256()
                for x in kept:
                    digest.update(x)
                out[0].append(len(doc))
                out[1].append(int((runs[:, 1] - runs[:, 0]).sum()))
                out[2].append(len(runs))
                out[3].append(digest.hexdigest())
                out[4].append([{"start": a, "end": b} for a, b in runs.tolist()])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span), strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Bytes to remove so that no ``window``-byte string of the input is left that occurs twice.

    docs: doc_id (long) and text; other columns are not read.  Returns a row per
    input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed
    byte runs.  A null text counts as empty; texts shorter than the window are
    kept whole; rows repeated with one id and text are copies of each other and
    so are removed; null ids are kept; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", *doc_key())
    ranges = repeated_windows(d, window)
    joined = d.join(ranges, ["kd", "kt"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column("text"))
            texts = []
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                doc = raw[off[i] : off[i + 1]]
                inner = (doc & 0xC0) == 0x80  # bytes within a character
                kept, at = [], 0
                for a, b in _runs(ranges, window).tolist():
                    while a < b and inner[a]:
                        a += 1
                    while b > a and b < len(doc) and inner[b]:
                        b -= 1
                    kept.append(doc[at:a].tobytes())
                    at = b
                kept.append(doc[at:].tobytes())
                texts.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated window cut out of ``text``.

    The cut runs are those of :func:`suffix_dedup`, drawn in to whole UTF-8
    characters so that the text stays valid.  All columns and rows stay; a null text
    becomes empty, and so does a text that only repeats others.
    """
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    d = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *doc_key())
    ranges = repeated_windows(d.select("kd", "kt", "text"), window)
    joined = d.join(ranges, ["kd", "kt"], "left").select("row", "text", "ranges")
    out = joined.mapInArrow(_strip(window), d.select("row", "text").schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("removed")
