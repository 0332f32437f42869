"""Document quality: random Fourier features, ridge by summed normal equations, isotonic calibration.

Only statistics of a text's own characters, words and lines are inputs.  Each
partition sums its part of the normal equations and of the calibration counts, fold by fold;
the driver solves systems whose size is a parameter, whatever the corpus size.  The
calibration sees each labelled row's score by the weights of the other folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table
from .minhash_dedup import _SPACE, shingles
from .textbytes import CHUNK, Rolling, by_bytes, view

#: Random features, ridge, kernel width (in standard deviations), steps of the calibration, folds that it is fitted over.
FEATURES, RIDGE, WIDTH, STEPS, SEED, FOLDS = 192, 1e-3, 4.0, 2000, 11, 4
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",;:", "cry": b"!?", "bar": b"|",
    "mark": b"#$%&*@^~+=_<>\\", "bracket": b"()[]{}\"'`", "line": b"\n", "space": b" \t\r",
}
_TABLE = np.full(256, len(_CLASSES), np.uint8)  # the last class: bytes of other characters
for _i, _c in enumerate(_CLASSES.values()):
    _TABLE[list(_c)] = _i
_N = len(_CLASSES) + 1


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each text; an empty text is all zeros."""
    seg, base = raw[off[0] : off[-1]], off - off[0]
    rows, size = len(off) - 1, np.diff(off).astype(float)
    if not len(seg):
        return np.zeros((rows, 16 + _N))
    doc = np.repeat(np.arange(rows), np.diff(off))
    count = np.bincount(doc * _N + _TABLE[seg], minlength=rows * _N).reshape(rows, _N)
    nonzero = np.maximum(size, 1)
    # lines: how many, how many distinct
    is_end = seg == 10
    edge = np.zeros(len(seg), bool)
    edge[base[1:][np.diff(off) > 0] - 1] = True
    line_end = np.flatnonzero(is_end | edge) + 1 - is_end[is_end | edge]
    line_start = np.concatenate([[0], np.flatnonzero(is_end | edge)[:-1] + 1])
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_doc = doc[line_start]
    lines = np.bincount(line_doc, minlength=rows)
    own_lines = _distinct(line_doc, Rolling(seg).of(line_start, line_end), rows)
    # words
    space = _SPACE[seg]
    doc_start = np.zeros(len(seg) + 1, bool)
    doc_start[base] = True
    start = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | doc_start[:-1]))
    end = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | doc_start[1:])) + 1
    word_doc = doc[start]
    words = np.bincount(word_doc, minlength=rows)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(word_doc, length, rows) / some
    spread = np.sqrt(np.maximum(np.bincount(word_doc, length**2, rows) / some - mean**2, 0))
    upper = (_TABLE[seg] == 0).astype(np.int64)
    caps = np.add.reduceat(np.append(upper, 0), np.stack([start, end], 1).ravel())[::2] if len(start) else np.zeros(0)
    all_caps = np.bincount(word_doc, (caps >= 2) & (caps * 2 > length), rows) / some
    letter = np.isin(_TABLE[seg], (0, 1, _N - 1)).astype(np.int64)
    letters = np.add.reduceat(np.append(letter, 0), np.stack([start, end], 1).ravel())[::2] if len(start) else np.zeros(0)
    no_letter = np.bincount(word_doc, letters == 0, rows) / some
    mostly_marks = np.bincount(word_doc, letters * 2 < length, rows) / some
    ends_mark = np.bincount(word_doc, np.isin(_TABLE[seg[end - 1]], (5, 6, 7)) if len(end) else None, rows) / some
    one, two, four = (np.diff(shingles(raw, off, k)[1]) for k in (1, 2, 4))
    h = Rolling(seg).of(start, end) if len(start) else np.zeros(0, np.uint64)
    again = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1]) if len(h) > 1 else np.zeros(0, bool)
    repeats = np.bincount(word_doc[1:], again, rows) / some if len(h) > 1 else np.zeros(rows)
    sentence = words / np.maximum(count[:, 3] + count[:, 5] / 4, 1)
    share = count / nonzero[:, None]
    out = np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), mean, spread, np.log1p(sentence), all_caps, no_letter, mostly_marks, ends_mark, repeats,
        one / some, two / some, four / some, own_lines / np.maximum(lines, 1), words / np.maximum(lines, 1) / 50, np.sqrt(share),
    ])
    out[size == 0] = 0
    return out


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])[: len(value)]
    return np.bincount(row[new], minlength=rows)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = view(batch.column("text"))
        for lo, hi in by_bytes(off, CHUNK // 2):
            x = statistics(raw, off[lo : hi + 1])
            at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["row", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Model:
    """Centre and scale of the statistics, the random features, ridge weights and the calibration's knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = r.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)) / 3)
        self.b = r.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.without = np.zeros((0, features + 1))  # the weights without each fold
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        phi = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.column_stack([phi, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by x: knots whose values never fall."""
    blocks: list[list[float]] = []  # value, weight, first x, last x
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, last = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + v * n) / (p[1] + n), p[1] + n, last
    xs = [v for p in blocks for v in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    ys = [v for p in blocks for v in ((p[0], p[0]) if p[3] > p[2] else (p[0],))]
    return np.array(xs), np.array(ys)


def _sums(model: Model, folds: int):
    """Each partition's sum of features times features and label by fold, as rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.weights)
        total = np.zeros((folds, d, d + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                phi, y, fold = model.features(_matrix(part.column("stats"))), part.column("y").to_numpy().astype(float), part.column("fold").to_numpy()
                for f in np.unique(fold):
                    p = phi[fold == f]
                    total[f] += p.T @ np.column_stack([p, y[fold == f]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds * d, dtype=np.int32)), pa.array(list(total.reshape(folds * d, d + 1)))], names=["i", "v"])

    return run


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = model.without[batch.column("fold").to_numpy()]
            raw = (model.features(_matrix(batch.column("stats"))) * weights).sum(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], names=["raw", "y"])

    return run


def solve(total: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from summed normal equations (d, d + 1), the last feature being the constant."""
    d = len(total)
    n = total[d - 1, d - 1]
    if not n:
        return np.zeros(d)
    return np.linalg.solve(total[:, :d] + ridge * n * np.diag([*[1.0 / (d - 1)] * (d - 1), 1e-9]), total[:, d])


def fit(s: Scratch, measured: DataFrame, labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, steps: int = STEPS, seed: int = SEED, folds: int = FOLDS) -> Model:
    """A model from all labelled rows (stats, y in {0, 1}, fold); the centre and scale come from all of ``measured``."""
    each = measured.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    got = sorted(each.collect())  # a row a statistic
    mean = np.array([r["m"] for r in got]) if got else np.zeros(1)
    sd = np.array([r["sd"] or 0.0 for r in got]) if got else np.ones(1)
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), features, width, seed)
    rows = s.save(labelled.select("stats", F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold")), "labelled")
    d = features + 1
    parts = rows.mapInArrow(_sums(model, folds), "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    flat = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("v")).collect()  # folds * d rows of d + 1 sums
    total = np.zeros((folds * d, d + 1))
    for r in flat:
        total[r["i"]] = [x["x"] for x in r["v"]]
    total = total.reshape(folds, d, d + 1)
    if not total[:, d - 1, d - 1].any():
        return model
    model.weights = solve(total.sum(0), ridge)
    model.without = np.array([solve(total.sum(0) - t, ridge) for t in total])
    bins = rows.mapInArrow(_raw(model), "raw double, y int").withColumn("bin", F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * steps))
    hist = sorted(bins.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect())  # 3 * steps rows at most
    model.knots = isotonic(np.array([r["x"] for r in hist]), np.array([r["y"] for r in hist]), np.array([float(r["n"]) for r in hist]))
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(_matrix(batch.column("stats"))))], names=["row", "score"])

    return run


def _held(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitted(docs: DataFrame, labels: DataFrame, texts: bool = False) -> tuple[Model, DataFrame]:
    """The model, and the stored table of ``row`` (a struct of the columns, of ``text`` only if ``texts``) and ``stats``."""
    s = Scratch(docs.sparkSession, "quality")
    columns = [c for c in docs.columns if texts or c != "text"]
    d = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    measured = s.save(d.mapInArrow(_measure, T.StructType([d.schema["row"], T.StructField("stats", T.ArrayType(T.DoubleType()))])), "statistics")
    known = labels.where("quality is not null and doc_id is not null").where(~_held("doc_id")).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").alias("y"))
    labelled = measured.select(F.col("row.doc_id").cast("long").alias("id"), "stats").join(known, F.col("id") == F.col("label_id"))
    return fit(s, measured, labelled.select("stats", "y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold"))), measured


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per input row: ``row`` (a struct of the columns but text), held_out, score and predicted.

    Labels are read only for ids whose crc32 modulo 5 is not 0.  labels: doc_id,
    quality (null: ignored).  A null text counts as empty and is scored too; repeated
    rows are scored each; a null id is not held out and has no label; without any usable
    label every score is 0.5; an empty table gives an empty result.
    """
    model, measured = _fitted(docs, labels)
    scored = measured.mapInArrow(_score(model), T.StructType([measured.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select("row", _held("row.doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects (score below the threshold).

    Rows are stored once with their statistics, so texts are measured once and never shuffled.
    """
    model, measured = _fitted(docs, labels, texts=True)
    scored = measured.mapInArrow(_score(model), T.StructType([measured.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") >= threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")
