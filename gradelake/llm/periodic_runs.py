"""Runs (maximal periodic stretches) of words in linear time over an ordered alphabet.

Words become letters of an alphabet ordered by first appearance.  A Lyndon array
tells for each place where the next smaller suffix starts; every run has, in the order
or in its reverse, a place whose longest Lyndon word is one period long.  Suffixes are
compared letter by letter, and a comparison inside a stretch that is a known copy of an
earlier one starts from what was matched there.  No suffix array, tree or hash is made.

Each document is judged on its own, so this is one pass over the table without a
shuffle; memory is about 200 bytes a word of one document.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_LENGTH = 6
MIN_EXPONENT = 4
WORDS = re.compile(r"[^ \t-\r]+").findall


def lyndon_edges(w: list[int], count: list[int] | None = None) -> tuple[list[int], dict[int, int]]:
    """Next smaller suffixes of ``w``, and by place how far the suffix there agrees with that one (zeros left out).

    The end counts as the smallest letter.  Places are visited from left to right with the
    chain of previous smaller suffixes; the furthest-reaching match so far says that
    ``w[i - shift:reach - shift]`` and ``w[i:reach]`` are equal, so a comparison with place i is answered by
    the one with place ``i - shift`` where that was made, unless it reaches the end of the match; then letters
    are read from there on, and from the start where it was not made (rare: in tests on repetitive strings less than four
    letters a place are read in all).  ``count`` (a list of one number) adds up the letters read.
    """
    n = len(w)
    w = [*w, -1]  # also what w[-1] reads: smaller than all
    following, before = [n] * n, [-1] * n
    agree: dict[int, int] = {}  # place -> agreement with the next smaller suffix
    back: dict[int, int] = {}  # place -> agreement with the previous smaller suffix
    reach = shift = inside = read = 0
    for i in range(1, n):
        x = w[i]
        j = i - 1
        while True:
            y = w[j]
            if y < x:
                break
            if y == x and j >= 0:
                h, known = 1, False
                if i < reach:
                    a, b = (j - shift, i - shift) if j >= inside else (j, i - shift)
                    if a > b:
                        a, b = b, a
                    known = a == b or following[a] == b or before[b] == a
                    if known:
                        h = min(reach - i, reach if a == b else agree[a] if following[a] == b else back[b])
                if not known or i + h == reach:
                    start = h
                    while w[j + h] == w[i + h] >= 0:
                        h += 1
                    read += h - start + 1
                    if i + h > reach:
                        reach, shift, inside = i + h, i - j, i
                if w[j + h] < w[i + h]:
                    back[i] = h
                    break
                agree[j] = h
            following[j] = i
            j = before[j]
        before[i] = j
    if count is not None:
        count[0] += read
    for j, nxt in enumerate(following):  # against the end of the text nothing agrees
        if nxt == n:
            agree.pop(j, None)
    return following, agree


def find_runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` by start, then period: stretches of smallest period q, as long as they go,
    of at least ``max(min_length, min_exponent * q)`` words.  ``min_exponent`` is 2 or more."""
    rank: dict = {}
    w = [rank.setdefault(x, len(rank)) for x in words]
    top = len(rank) - 1
    found: set[tuple[int, int, int]] = set()
    for letters in (w, [top - x for x in w]):
        following, agree = lyndon_edges(letters)
        done: dict[int, int] = {}  # period -> end of the last stretch looked at
        for i in sorted(agree) if min_exponent > 2 else range(len(w)):
            right = agree.get(i, 0)
            p = following[i] - i
            if i + p >= len(w) or right < (min_exponent - 2) * p or i + p < done.get(p, 0):
                continue
            left = 0
            while left < i and w[i - 1 - left] == w[i + p - 1 - left]:
                left += 1
            done[p] = i + p + right
            length = left + p + right
            if length >= max(min_length, min_exponent * p):
                found.add((i - left, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a periodic tail in one document of ten, fixed by the crc32 of its id; a null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return (words[:a] + unit * ((n - a) // p + 1))[:n]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without what any run repeats: of each run its first period stays."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if b > at:
            out += words[at : max(a, at)]
            at = b
    return out + words[at:]


def digest(words: list[str], **limits: int) -> tuple:
    runs = find_runs(words, **limits)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    s, n, q = best or (None, None, None)
    said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(collapse(words, runs))
    return len(runs), s, n, q, best and 1000 * n // q, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def _by_batch(change, kinds, make):
    """A batch function: each row's words (changed by its id), and what ``make`` gives for them, once a text that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                known: dict[str, tuple] = {}
                rows = []
                for doc, text in zip(ids.slice(lo, 256).to_pylist(), texts.slice(lo, 256).to_pylist(), strict=True):
                    text = text or ""
                    words = WORDS(text)
                    now = change(words, doc) if change else words
                    if now is not words:
                        rows.append((doc, *make(now)))
                        continue
                    if text not in known:
                        known[text] = make(words)
                    rows.append((doc, *known[text]))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return run


def text_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Periodic runs of words of each document: doc_id, runs (array of start, length, period), kept (text without the repeats).

    docs: doc_id and text; other columns are not read.  Words are separated by ASCII white space.  ``kept`` joins
    words by one space.  A null or empty text has no runs and an empty ``kept``; repeated rows and null ids give a row each.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make(words: list[str]) -> tuple:
        found = find_runs(words, min_length, min_exponent)
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], " ".join(collapse(words, found))

    kinds = {"doc_id": pa.int64(), "runs": pa.list_(run), "kept": pa.string()}
    out = "doc_id long, runs array<struct<start long, length long, period long>>, kept string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_by_batch(None, kinds, make), out)


def run_digest(docs: DataFrame, change=None) -> DataFrame:
    """A row a document: number of runs, the longest one (nulls where there is none), and digests of all runs and of the text without repeats.

    ``change(words, doc_id)`` may replace the words before they are judged (it returns the same list where it changes nothing).
    Null and empty texts have no words; repeated rows and null ids give a row each; an empty table gives none.
    """
    long, text = pa.int64(), pa.string()
    kinds = {"doc_id": long, "n_runs": long, "start": long, "length": long, "period": long, "exponent_milli": long, "runs_sha256": text, "collapsed_sha256": text}
    out = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_by_batch(change, kinds, digest), out)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with the periodic tails that the contract plants."""
    return run_digest(table(spark, sf_dir, "documents"), planted)
