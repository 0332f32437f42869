"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

1. Every document becomes its set of distinct word shingles (64-bit hashes).  Documents with one and the same set (told
   by its size and two 64-bit sums) are one *node* with a number of its own; the rest of the work is on nodes.
2. One hash of each shingle gives both a bin and a value; a bin keeps its least value (one-permutation hashing), and an
   empty bin copies a non-empty one that a universal hash of (bin, attempt) picks (optimal densification).
3. Bins are banded.  In each bucket all members are joined to its least member only (a star), so a bucket of m
   nodes gives m - 1 candidates.  Candidates are confirmed on the full sets.
4. A star can miss a link between two outer members.  Buckets are grouped into connected candidate groups; where a group
   did not end as one component, its nodes are compared on full sets, block by block of bounded size.  A group of more blocks
   than a node has buckets (texts from templates chain many buckets together) is banded anew instead, in more and longer bands with
   the same chance of a miss, which unlike texts seldom share, and only nodes of
   different components in one bucket are compared: so no node is sent to more tasks than it has buckets.  Blocks
   that are one component already are passed over, and only links that join components leave a block.  No list of pairs
   is made, and work follows the sizes of buckets, not of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, doc_key, free_name, table
from .textbytes import CHUNK, Rolling, by_bytes, mix, view

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Set elements that one block of a comparison holds, and documents.
BLOCK_ELEMENTS, BLOCK_ROWS = 200_000, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, miss: float = 1e-8, longer: int = 1) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares no bucket with probability ``miss`` at most; ``longer`` times the usual rows."""
    rows = (6 if threshold >= 0.84 else 5) * longer
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return bands, rows


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by (row, hash), and the row offsets into them.

    Words are maximal runs without ASCII white space, A-Z in lower case; a text of
    fewer than ``k`` words has its whole word sequence as its only shingle.
    """
    seg = _LOWER[raw[off[0] : off[-1]]]
    base = off - off[0]
    n, rows = len(seg), len(off) - 1
    space = _SPACE[seg]
    edge = np.zeros(n + 1, bool)
    edge[base] = True
    is_word = ~space
    begins = is_word & (np.concatenate([[True], space[:-1]]) | edge[:n]) if n else is_word
    ends = is_word & (np.concatenate([space[1:], [True]]) | edge[1:]) if n else is_word
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = Rolling(seg).of(start, end)
    row = np.searchsorted(base, start, side="right") - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[row]
    have = np.minimum(k, count[row] - place)  # words from here to the end of the text, k at most
    value = np.full(len(word), 0x51ED270B9A8F7C63, np.uint64)
    for j in range(k):
        nxt = np.zeros(len(word), np.uint64)
        nxt[: max(len(word) - j, 0)] = word[j:]
        value = np.where(have > j, mix(value * _ODD + nxt), value)
    keep = (have == k) | (place == 0)
    value, row = value[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
    value, row = value[new], row[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def signatures(value: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """One value a bin and row, by one permutation with optimal densification; rows without elements stay 0."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    bin_of = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    low = mix(value ^ np.uint64(0xD6E8FEB86659FD93))
    cell = row * bins + bin_of
    out = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
    order = np.lexsort((low, cell))
    cell, low = cell[order], low[order]
    head = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    out[cell[head]] = low[head]
    filled = np.zeros(rows * bins, bool)
    filled[cell[head]] = True
    out, filled = out.reshape(rows, bins), filled.reshape(rows, bins)
    donor = out.copy()
    todo_row, todo_bin = np.nonzero(~filled & (np.diff(off) > 0)[:, None])
    attempt = 0
    while len(todo_row):
        attempt += 1
        pick = (mix(todo_bin.astype(np.uint64) * _ODD + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[todo_row, pick]
        out[todo_row[hit], todo_bin[hit]] = donor[todo_row[hit], pick[hit]]
        todo_row, todo_bin = todo_row[~hit], todo_bin[~hit]
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    """Bucket names (row, band) of signatures (row, band, place)."""
    n, bands, rows = sig.shape
    band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, (n, bands)).copy()
    for j in range(rows):
        band = mix(band * _ODD + sig[:, :, j])
    return band


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column("text"))
            for lo, hi in by_bytes(off, CHUNK // 2):
                value, at = shingles(raw, off[lo : hi + 1], k)
                size = np.diff(at)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value), dtype=np.uint64)])
                twin = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
                names = [mix((t[at[1:]] - t[at[:-1]]) * _ODD + size.astype(np.uint64)).view(np.int64) for t in (total, twin)]
                sig = signatures(value, at, bands * rows).reshape(hi - lo, bands, rows)
                band = buckets(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "kd", "kt")], pa.array(size.astype(np.int64)), *map(pa.array, names), lists],
                    names=["doc_id", "kd", "kt", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column("text"))
            for lo, hi in by_bytes(off, CHUNK // 2):
                value, at = shingles(raw, off[lo : hi + 1], k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), lists], names=["node", "items"])

    return run


def _longer(bands: int, rows: int):
    """(node, comp, items) to node, comp and the buckets of longer bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                items = part.column("items")
                value = items.flatten().to_numpy().view(np.uint64)
                off = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
                band = buckets(signatures(value, off, bands * rows).reshape(len(part), bands, rows)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("comp"), lists], names=["node", "comp", "bands"])

    return run


def block_links(num: int, den: int):
    """Compares two blocks of sets; returns links that join components within the pair, a forest at most."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[1], key[2]
        a = pdf[pdf.block == bi].reset_index(drop=True)
        b = a if bi == bj else pdf[pdf.block == bj].reset_index(drop=True)
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        vocabulary = np.unique(np.concatenate(list(a["items"])))
        size_a, size_b = a["items"].map(len).to_numpy(), b["items"].map(len).to_numpy()
        inter = np.zeros((len(a), len(b)), np.float32)
        step = 4096  # columns of the incidence matrices at a time
        where = [np.searchsorted(vocabulary, x) for x in a["items"]]
        there = []
        for x in b["items"]:
            p = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
            there.append(p[vocabulary[p] == x])
        for at in range(0, len(vocabulary), step):
            parts = []
            for places in (where, there):
                m = np.zeros((len(places), min(step, len(vocabulary) - at)), np.float32)
                for i, p in enumerate(places):
                    q = p[(p >= at) & (p < at + step)] - at
                    m[i, q] = 1
                parts.append(m)
            inter += parts[0] @ parts[1].T
        union = size_a[:, None] + size_b[None, :] - inter
        hit = (den * inter.astype(np.int64) >= num * union.astype(np.int64)) & (a["comp"].to_numpy()[:, None] != b["comp"].to_numpy()[None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        ca, cb = a["comp"].to_numpy(), b["comp"].to_numpy()
        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = root(int(ca[i])), root(int(cb[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ca[i]), int(cb[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _within_buckets(s: Scratch, large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, gid, comp) of large groups once for each longer bucket that holds several components; buckets of the same members count once."""
    bands, rows = bands_for(threshold, longer=2)
    banded = large.join(sets, "node").select("node", "comp", "items").mapInArrow(_longer(bands, rows), "node long, comp long, bands array<long>")
    spread = s.save(banded.select("node", F.explode("bands").alias("gid"), "comp"), "spread")
    seen = spread.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *[F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)])
    once = s.save(seen.where("lo <> hi").groupBy("h0", "h1").agg(F.min("gid").alias("gid")).select("gid"), "once")
    out = s.save(spread.join(once, "gid", "left_semi").select("node", "gid", "comp"), "shared")
    s.drop(spread, once)
    return out


def _missed(s: Scratch, sets: DataFrame, stand: DataFrame, group: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Links (as pairs of components) in candidate groups that did not end as one component."""
    member = group.join(comp, "node", "left").select("node", "gid", F.coalesce("comp", "node").alias("comp"))
    member = s.save(member.join(stand.select("node", "n"), "node"), "grouped")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_ELEMENTS), F.ceil(F.count("*") / (BLOCK_ROWS // 2)))
    fills = blocks > bands_for(num / den, longer=2)[0]
    open_ = s.save(member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), fills.alias("large")).where("lo <> hi").select("gid", "large"), "open")
    small = member.join(open_.where("not large"), "gid", "left_semi").select("node", "gid", "comp")
    if open_.where("large").isEmpty():
        member = small
    else:
        large = member.join(open_.where("large"), "gid", "left_semi").select("node", "comp")
        member = small.union(_within_buckets(s, large, sets, num / den))
    member = s.save(member.join(sets, "node").select("node", "gid", "comp", "items", F.size("items").alias("n")), "members")
    # a component that fills blocks of its own is a unit; what is smaller shares unit -1
    sizes = member.groupBy("gid", "comp").agg(F.sum("n").alias("elements"), F.count("*").alias("m"))
    unit = F.when((F.col("elements") >= BLOCK_ELEMENTS) | (F.col("m") >= BLOCK_ROWS // 2), F.col("comp")).otherwise(F.lit(-1))
    sizes = s.save(sizes.withColumn("unit", unit), "units")
    parts = F.greatest(F.ceil(F.sum("elements") / BLOCK_ELEMENTS), F.ceil(F.sum("m") / (BLOCK_ROWS // 2))).cast("int")
    blocks = sizes.groupBy("gid", "unit").agg(parts.alias("parts"), F.count("*").alias("comps"))
    placed = member.join(sizes.select("gid", "comp", "unit"), ["gid", "comp"]).join(blocks, ["gid", "unit"])
    placed = placed.withColumn("block", F.xxhash64("unit", F.expr("cast(pmod(xxhash64(node), parts) as int)")))
    # the blocks that nodes were really placed in: where sets are longer than a block, others stay empty
    filled = s.save(placed.select("gid", "unit", "comps", "block").distinct(), "filled")
    left = filled.select("gid", F.col("block").alias("bi"), F.col("unit").alias("ui"), F.col("comps").alias("ci"))
    right = filled.select("gid", F.col("block").alias("bj"), F.col("unit").alias("uj"))
    pairs = left.join(right, "gid").where("bi <= bj and not (ui = uj and ci = 1)").select("gid", "bi", "bj")
    placed = placed.select("gid", "comp", "block", "items")
    ends = pairs.select("gid", "bi", "bj", F.col("bi").alias("block")).union(pairs.where("bi <> bj").select("gid", "bi", "bj", F.col("bj").alias("block")))
    rows = ends.join(placed, ["gid", "block"])
    return rows.groupBy("gid", "bi", "bj").applyInPandas(block_links(num, den), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Groups of documents linked by ``den * |A & B| >= num * |A | B|`` over sets of ``k``-word shingles.

    docs: doc_id (long), text; other columns are not read.  A row per input row:
    doc_id, n_shingles, component_id (least doc_id reachable by links, itself
    included) and kept (doc_id = component_id).  A null, empty or blank text has no
    shingles and links with nothing.  Rows repeated with one id are one document
    for the component and each gets its row; a null id never becomes a component id
    unless its whole component has null ids.  An empty table gives an empty result.
    """
    s = scratch or Scratch(docs.sparkSession, "minhash")
    bands, rows = bands_for(num / den)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *doc_key())
    sketch = s.save(d.mapInArrow(_sketch(k, bands, rows), "doc_id long, kd long, kt long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketch")
    full = sketch.where("n_shingles > 0")
    # one stand-in document for each node
    stand = full.groupBy("h1", "h2").agg(F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("kd").alias("kd"), F.first("kt").alias("kt"))
    stand = s.save(stand.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = stand.select("node", F.explode("bands").alias("bucket"))
    shared = s.save(spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").select("bucket", "hub"), "buckets")
    star = s.save(spread.join(shared, "bucket").where("node <> hub").select("hub", "node").distinct(), "stars")
    s.drop(shared)
    touched = s.save(star.select("node").union(star.select("hub")).distinct(), "touched")
    need = stand.join(touched, "node", "left_semi").select("node", "kd", "kt")
    need = s.save(need, "need")
    # a merge join: the same plan at every size
    texts = d.select("kd", "kt", "text").join(need.hint("merge"), ["kd", "kt"]).select("node", "text")
    sets = s.save(texts.mapInArrow(_sets(k), "node long, items array<long>"), "sets")
    links = _confirm(s, star, sets, num, den)
    comp = components(s, links, "hub", "node").withColumnRenamed("id", "node")
    group = components(s, star, "hub", "node").select(F.col("id").alias("node"), F.col("comp").alias("gid"))
    more = s.save(_missed(s, sets, stand, group, comp, num, den), "missed")
    s.drop(sets, star, links, touched, need)
    over = components(s, more).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    comp = stand.select("node", "h1", "h2").join(comp, "node", "left").select("h1", "h2", F.coalesce("comp", "node").alias("comp"))
    comp = comp.join(over, "comp", "left").select("h1", "h2", F.coalesce("top", "comp").alias("comp"))
    comp = s.save(comp, "components")
    named = s.save(full.select("h1", "h2", "doc_id").join(comp, ["h1", "h2"]).groupBy("comp").agg(F.min("doc_id").alias("component_id")), "names")
    at = s.save(comp.join(named, "comp").select("h1", "h2", "component_id"), "node-names")
    out = sketch.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(h)).alias(h) for h in ("h1", "h2")]).join(at, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"))


def _confirm(s: Scratch, star: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Star edges whose full sets are similar enough."""
    hubs = s.save(star.select(F.col("hub").alias("node")).distinct().join(sets, "node").select(F.col("node").alias("hub"), F.col("items").alias("of_hub")), "hubs")
    half = star.join(sets, "node")
    both = half.join(hubs, "hub").withColumn("i", F.size(F.array_intersect("items", "of_hub")).cast("long"))
    links = both.where(F.lit(den) * F.col("i") >= F.lit(num) * (F.size("items") + F.size("of_hub") - F.col("i")))
    links = s.save(links.select("hub", "node"), "links")
    s.drop(hubs)
    return links


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, one of least doc_id (null after all others).

    Among rows of one doc_id the hash of the text decides.  Rows are told apart by a
    number of their own, so repeated rows and null ids are groups like any other; rows
    without shingles link with nothing and all stay.
    """
    s = Scratch(docs.sparkSession, "keep-one")
    row = free_name(docs, "row")
    rows = s.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    work = Scratch(docs.sparkSession, "minhash")
    near = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), k, num, den, work)
    extra = s.save(near.where("not kept").select(F.col("doc_id").alias("r"), "component_id"), "extra")
    work.clear()
    member = extra.union(extra.select("component_id", "component_id").distinct())
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col(row).alias("r"))
    member = s.save(rows.select(rank.alias("rank")).join(member, F.col("rank.r") == F.col("r")).select("component_id", "rank"), "ranks")
    stay = member.groupBy("component_id").agg(F.min("rank").alias("least")).select(F.col("least.r").alias("stay"))
    # stored, so that its size is known: where it is small, texts are not shuffled
    gone = s.save(member.select(F.col("rank.r").alias("gone")).join(stay, F.col("gone") == F.col("stay"), "left_anti"), "gone")
    s.drop(extra, member)
    return rows.join(gone, rows[row] == gone.gone, "left_anti").drop(row)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
