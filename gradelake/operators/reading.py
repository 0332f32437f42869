"""The order in which blocks of a page are read.

A page is cut at gutters again and again.  A gutter is a vertical strip that fewer blocks
cross than any other place in the middle of the page, so a title over all columns does not hide it: crossings are
counted at every position by one sweep over where blocks begin and end.  What crosses
the gutter is read before the columns where it stands above them, else after.  A column without a
gutter is read in bands: blocks that overlap vertically by half of the lower one are one line, read from left to right.

A page's blocks are gathered in one row (a page holds hundreds, not millions); pages are spread over the cluster, and those of
a batch are cut and read side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Where gutters are looked for (shares of the width), how wide one is, how many blocks two columns hold, how far lines overlap, how deep columns nest.
POSITIONS = np.array([0.25 + i * 0.005 for i in range(101)])
LEAST_RUN = 6
COLUMN_SHARE = 0.8
OVERLAP = 0.5
DEPTH = 3

X0, Y0, X1, Y1 = range(4)


def gutters(box: np.ndarray, seg: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each segment (rows x0, y0, x1, y1 of ``box``, the width being 1) is cut, or nan; ``seg`` numbers the rows' segments."""
    wide = len(POSITIONS) + 1
    begin = np.searchsorted(POSITIONS, box[:, X0], side="right")
    end = np.maximum(begin, np.searchsorted(POSITIONS, box[:, X1], side="left"))
    change = np.bincount(seg * wide + begin, minlength=len(size) * wide) - np.bincount(seg * wide + end, minlength=len(size) * wide)
    crossed = np.cumsum(change.reshape(-1, wide), axis=1)[:, :-1]
    fewest = crossed.min(axis=1)
    run, longest, last = (np.zeros(len(size), int) for _ in range(3))
    for i, least in enumerate((crossed == fewest[:, None]).T):
        run = (run + 1) * least
        last = np.where(run > longest, i, last)
        longest = np.maximum(longest, run)
    cut = POSITIONS[last - longest + 1] + (longest - 1) * 0.005 / 2
    return np.where((size >= 4) & (fewest <= np.maximum(2, np.rint(size * 0.2))) & (longest >= LEAST_RUN), cut, np.nan)


def bands(box: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The rows of columns (numbered by ``seg`` in reading order) line by line; all columns take a step at a time."""
    rows = np.lexsort((box[:, X0], box[:, Y0], seg))  # stable: equal places stay in the order of drawing
    start = np.flatnonzero(np.diff(seg[rows], prepend=-1))
    length = np.diff(start, append=len(rows))
    start, length = (x[np.argsort(-length, kind="stable")] for x in (start, length))
    y0, y1 = box[rows, Y0], box[rows, Y1]
    new = np.zeros(len(rows), int)
    new[start] = 1
    top, bottom = y0[start], y1[start]
    for step in range(1, length[0] if len(length) else 0):
        n = np.searchsorted(-length, -step)  # columns longer than this come first
        at = start[:n] + step
        lower = np.minimum(y1[at] - y0[at], bottom[:n] - top[:n])
        with np.errstate(divide="ignore", invalid="ignore"):
            same = (lower > 0) & ((np.minimum(y1[at], bottom[:n]) - np.maximum(y0[at], top[:n])) / lower >= OVERLAP)
        new[at] = ~same
        top = np.where(same, np.minimum(top[:n], y0[at]), y0[at])
        bottom = np.where(same, np.maximum(bottom[:n], y1[at]), y1[at])
    return rows[np.lexsort((rows, y0, box[rows, X0], np.cumsum(new)))]


def pages_order(box: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Row numbers of boxes in reading order, page after page; ``page`` numbers the rows' pages from 0."""
    path = page.astype(np.int64)  # the page, then a digit a depth: above 0, left 1, right 2, below 3
    open_ = np.arange(len(box))
    for depth in range(DEPTH):
        path *= 4
        _, seg, size = np.unique(path[open_], return_inverse=True, return_counts=True)
        b = box[open_]
        if depth:
            low, high = np.full(len(size), np.inf), np.full(len(size), -np.inf)
            np.minimum.at(low, seg, b[:, X0])
            np.maximum.at(high, seg, b[:, X1])
            width = high - low
            keep = width[seg] > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                b[:, [X0, X1]] = (b[:, [X0, X1]] - low[seg, None]) / width[seg, None]
        else:
            keep = np.ones(len(b), bool)
        open_, b, kept = open_[keep], b[keep], seg[keep]
        cut = gutters(b, kept, size)[kept]
        left, right = b[:, X1] <= cut, b[:, X0] >= cut
        beside = left | right
        count = lambda mask, of=kept, n=len(size): np.bincount(of[mask], minlength=n)
        cuts = ((count(left) >= 2) & (count(right) >= 2) & (count(beside) / size >= COLUMN_SHARE))[kept]
        head = np.full(len(size), np.inf)
        np.minimum.at(head, kept[beside], b[beside, Y0])
        part = np.where(left, 1, np.where(right, 2, np.where(b[:, Y1] <= head[kept], 0, 3)))
        path[open_] += np.where(cuts, part, 0)
        open_ = open_[cuts & beside]
    return bands(box, path)


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        boxes = batch.column("boxes")
        flat, ends = boxes.flatten(), boxes.offsets.to_numpy() - boxes.offsets[0].as_py()
        corner = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], 1)
        place = np.zeros(len(flat), np.int32)
        parent = np.repeat(np.arange(len(boxes)), np.diff(ends))
        place[pages_order(corner, parent)] = np.arange(len(flat)) - ends[parent] + 1
        yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(parent)), flat.field("block"), pa.array(place)], names=["page", "block", "place"])


def reading_order(blocks: DataFrame) -> DataFrame:
    """(page, block, place): the blocks of each page in reading order, from 1.

    blocks: page, block (in the order of drawing, which breaks ties) and x0, y0, x1, y1 as shares of the page; a missing corner is 0, corners may be given in either order.  Blocks of a null page are one
    page; an empty table gives an empty result.
    """
    at = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")}
    corners = [pick(at[f"{c}0"], at[f"{c}1"]).alias(f"{c}{k}") for k, pick in ((0, F.least), (1, F.greatest)) for c in "xy"]
    pages = blocks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("block", *corners))).alias("boxes"))
    out = S.StructType([S.StructField(c, blocks.schema[c].dataType) for c in ("page", "block")] + [S.StructField("place", S.IntegerType())])
    return pages.mapInArrow(_order, out)
