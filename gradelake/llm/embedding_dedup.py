"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept a group.

A vector belongs to the cell of its nearest centroid.  A near neighbour may lie just
across a cell's border, so a vector also visits each later cell whose border is
within ``margin`` of it (the sine of its angle to the border).  ``margin =
sqrt(1 - threshold**2)`` is exact: no partner can lie farther over.  Cells are cut
into blocks of bounded size, so a hot cell is many small tasks; a task multiplies two
blocks and returns counts and a spanning forest, never the list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

THRESHOLD = 0.9
#: Vectors that centroids are fitted on, at most; vectors in one block; vectors a cell on average; cells at most (beyond, cells grow;
#: the centroids are broadcast).  At the exact margin a vector visits up to half of the cells, so cells are few and large: below a
#: few thousand vectors a cell, visits outgrow what cells save.
SAMPLE, BLOCK, CELL, CELLS = 16_384, 2048, 8192, 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; empty cells take the vector that is farthest from its own."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        dots = x @ c.T
        near = dots.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(dots.max(1))[: len(empty)]]
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(centroids: np.ndarray, margin: float):
    """Rows (vec, dim, embedding) to rows for each cell that the vector belongs to or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                if not part.num_rows:
                    continue
                dim = part.column("dim").to_numpy()
                row, cell, home = [], [], []
                fit = np.flatnonzero(dim == centroids.shape[1])
                if len(fit):
                    dots = _unit(part.column("embedding").take(pa.array(fit))) @ centroids.T
                    own = dots.argmax(1)
                    over = dots[np.arange(len(fit)), own][:, None] - dots
                    apart = np.sqrt(np.maximum(2 - 2 * (centroids[own] @ centroids.T), 0))  # of unit centroids
                    visit = (over <= margin * apart + 1e-7) & (np.arange(len(centroids))[None, :] > own[:, None])
                    i, c = np.nonzero(visit)
                    row, cell, home = [fit, fit[i]], [own, c], [np.ones(len(fit), bool), np.zeros(len(i), bool)]
                rest = np.flatnonzero(dim != centroids.shape[1])  # vectors of other lengths have a cell of their own length each
                row, cell, home = (np.concatenate([*a, b]) for a, b in ((row, rest), (cell, np.full(len(rest), -1)), (home, np.ones(len(rest), bool))))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec").take(at), part.column("weight").take(at), part.column("dim").take(at), pa.array(cell.astype(np.int32)), pa.array(home), part.column("embedding").take(at)],
                    names=["vec", "weight", "dim", "cell", "home", "embedding"],
                )

    return run


def _compare(threshold: float):
    """One pair of blocks: per vector the weight of its partners and a root that it is linked to."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[2], key[3]
        sides = []
        for b in (bi, bj):
            p = pdf[pdf.block == b]
            x = np.stack(p["embedding"].to_numpy()).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            sides.append((p["vec"].to_numpy(), p["weight"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)))
        (ids, w, x), (jds, v, y) = sides
        near = x @ y.T >= threshold
        if bi == bj:
            np.fill_diagonal(near, False)
        if not near.any():
            return pd.DataFrame({"vec": [], "n": [], "root": []}, dtype="int64")
        out = {}
        for names, count in ((ids, near @ v), (jds, near.T @ w) if bi != bj else (ids[:0], w[:0])):
            for a, n in zip(names.tolist(), count.tolist(), strict=True):
                if n:
                    out[a] = [n, a]
        parent = {a: a for a in out}

        def root(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for i in np.flatnonzero(near.any(1)):
            a = int(ids[i])
            for b in jds[near[i]].tolist():
                p, q = root(a), root(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        return pd.DataFrame([(a, n, root(a)) for a, (n, _) in out.items()], columns=["vec", "n", "root"]).astype("int64")

    return run


def embedding_links(s: Scratch, vectors: DataFrame, threshold: float, cells: int | None, margin: float | None, block: int = BLOCK) -> DataFrame:
    """vectors: vec, weight, dim, embedding (distinct) to (vec, n, root) rows, several a vector."""
    size = vectors.agg(F.count("*").alias("n"), F.mode("dim").alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    k = cells or min(CELLS, max(1, n // CELL))
    sample = vectors.where(F.col("dim") == dim).where(F.rand(17) < min(1.0, 2 * SAMPLE / max(n, 1))).select("embedding").limit(SAMPLE).toPandas()
    if len(sample):
        x = np.stack(sample["embedding"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        centroids = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    else:
        centroids = np.zeros((0, dim))
    margin = math.sqrt(1 - threshold**2) if margin is None else margin
    kind = f"vec long, weight long, dim int, cell int, home boolean, embedding {vectors.schema['embedding'].dataType.simpleString()}"
    rows = s.save(vectors.select("vec", "weight", "dim", "embedding").mapInArrow(_cells(centroids, margin), kind), "cells")
    parts = rows.groupBy("dim", "cell", "home").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    parts = s.save(parts, "parts")
    # block numbers: those at home from 0, those of visitors from 2**20
    placed = rows.join(parts, ["dim", "cell", "home"]).withColumn("block", F.expr("cast(pmod(xxhash64(vec), parts) as int) + if(home, 0, 1048576)"))
    lists = parts.select("dim", "cell", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    home = lists.where("home").select("dim", "cell", F.col("p").alias("bi"))
    other = lists.select("dim", "cell", F.expr("p + if(home, 0, 1048576)").alias("bj"))
    pairs = home.join(other, ["dim", "cell"]).where("bi <= bj")
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj"))))
    work = ends.join(placed.select("dim", "cell", "block", "vec", "weight", "embedding"), ["dim", "cell", "block"])
    return s.save(work.groupBy("dim", "cell", "bi", "bj").applyInPandas(_compare(threshold), "vec long, n long, root long"), "links")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cells: int | None = None, margin: float | None = None) -> DataFrame:
    """A row per input row: vec_id, n_links, component_id (least vec_id of the group) and kept.

    vectors: vec_id (long) and embedding; other columns are not read.  Two rows are
    linked at a cosine of ``threshold`` or more in double precision.  A vector that is
    null, empty, zero, or holds null or non-finite components links with nothing, as
    do vectors of different lengths.  Equal vectors are compared once and counted each;
    rows repeated with one vec_id are rows of one group; an empty table gives an
    empty result.
    """
    s = Scratch(vectors.sparkSession, "embedding")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("embedding", F.when(fine, F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))))  # -0.0 to 0.0
    whole = v.where("embedding is not null")
    distinct = whole.groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    names = [F.xxhash64("embedding", F.lit(i)).alias(f"h{i}") for i in (1, 2)]  # 128 bits tell vectors apart; a number stands for each from here on
    distinct = s.save(distinct.select(F.monotonically_increasing_id().alias("vec"), *names, "weight", "low", F.size("embedding").alias("dim"), "embedding"), "distinct")
    links = embedding_links(s, distinct, threshold, cells, margin)
    comp = components(s, links, "vec", "root")
    degree = links.groupBy("vec").agg(F.sum("n").alias("n"))
    group = distinct.select("vec", "h1", "h2", "low", "weight").join(comp, distinct.vec == comp.id, "left").select("vec", "h1", "h2", "low", "weight", F.coalesce("comp", "vec").alias("comp"))
    named = group.groupBy("comp").agg(F.min("low").alias("component_id"))
    known = group.join(named, "comp").join(degree, "vec", "left").select("h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    known = s.save(known, "known")
    out = v.select("vec_id", *[F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.lit(i))).alias(f"h{i}") for i in (1, 2)]).join(known, ["h1", "h2"], "left")
    top = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), top.alias("component_id"), F.col("vec_id").eqNullSafe(top).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
