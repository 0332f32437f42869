"""Documents: duplicates, running heads, sections, references, similar texts and vectors."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.numeric import round_half_up
from ..sources.shared import stored


def hash_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's content hash, the first document with it, and how many share it."""
    d = stored(docs.select(key, X.content_hash(text).alias("hash")), "hashes")  # texts are read and hashed once
    g = d.groupBy("hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return d.join(g, "hash").select(key, "hash", "first_id", "copies")


def running_heads(lines: DataFrame, group: str, page: str, line: str, least: int = 2, part: float = 0.4, min_pages: int = 4) -> DataFrame:
    """Lines that, digits aside, stand on at least max(2, 40 %) of a group's pages (of four or more)."""
    bare = F.trim(F.regexp_replace(F.col(line), r"\d+", "#"))
    pages = lines.groupBy(group).agg(F.countDistinct(page).alias("pages"))
    g = lines.where(bare != "").groupBy(group, bare.alias("head")).agg(F.countDistinct(page).alias("on_pages"))
    return g.join(pages, group).where((F.col("pages") >= min_pages) & (F.col("on_pages") >= F.greatest(F.lit(float(least)), F.col("pages") * part))).select(group, "head", "on_pages", "pages")


def sections(lines: DataFrame, key: str, order: str, is_header: Column) -> DataFrame:
    """Numbers the sections of each document: a header starts one; what stands before the first is section 0."""
    w = Window.partitionBy(key).orderBy(order)
    return lines.withColumn("section", F.sum(is_header.cast("int")).over(w))


def merge_continued(rows: DataFrame, key: str, order: str, continued: Column, text: str) -> DataFrame:
    """Rows that continue the one before are joined to it."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("unit", F.sum((~F.coalesce(continued, F.lit(False))).cast("int")).over(w))
    return r.groupBy(key, "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text), F.count("*").alias("parts"))


def dangling(children: DataFrame, parents: DataFrame, child_ref: str, parent_key: str, code: str) -> DataFrame:
    """(code, ref): references without a target."""
    refs = children.where(F.col(child_ref).isNotNull()).select(F.col(child_ref).alias("ref"))
    return refs.join(parents.select(F.col(parent_key).alias("ref")).distinct(), "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.col("ref").cast("string").alias("ref"), "n")


def duplicate_options(options: DataFrame, question: str, content: str) -> DataFrame:
    """Questions with equal option texts (white space and case aside)."""
    c = F.lower(F.regexp_replace(F.trim(F.col(content)), r"\s+", " "))
    return options.groupBy(question, c.alias("content")).agg(F.count("*").alias("n")).where("n > 1")


def _rarest_first(texts: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(key, grams, size): each text's trigrams, those that few texts have in front."""
    g = texts.select(key, F.explode(X.trigrams("text")).alias("g")).join(counts, "g")
    return g.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("grams")).withColumn("size", F.size("grams"))


def text_pairs(queries: DataFrame, candidates: DataFrame, floor: float) -> DataFrame:
    """(query_id, item_id): all pairs that can reach a Jaccard of ``floor`` (above 0), by prefix, length and place.

    queries and candidates: id, grams (rarest first), size.  Two sets that reach it share a gram among the first ``size - ceil(floor * size) + 1`` of both, so
    the most frequent grams are never joined; sizes differ by the floor at most, and what is left behind the shared places must be enough.
    """
    def prefix(df: DataFrame, key: str, name: str) -> DataFrame:
        first = F.col("size") - F.ceil(F.col("size") * (floor - 1e-9)) + 1
        return df.select(key, F.posexplode(F.slice("grams", 1, first.cast("int"))).alias(f"at_{name}", "g"), F.col("size").alias(f"size_{name}"))

    j = prefix(queries, "query_id", "q").join(prefix(candidates, "item_id", "c"), "g")
    sizes = (F.col("size_c") >= F.col("size_q") * (floor - 1e-9)) & (F.col("size_q") >= F.col("size_c") * (floor - 1e-9))
    most = F.least(F.col("size_q") - F.col("at_q"), F.col("size_c") - F.col("at_c"))
    first = F.min(F.struct("at_q", most.alias("most"), "size_q", "size_c")).alias("f")  # the first shared gram bounds all that are shared
    pairs = j.where(sizes).groupBy("query_id", "item_id").agg(first)
    return pairs.where(F.col("f.most") * (1 + floor) >= (F.col("f.size_q") + F.col("f.size_c")) * (floor - 1e-9)).select("query_id", "item_id")


def _code_grams(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): the distinct trigrams of each lower-cased text with its blanks, three code points of 21 bits in one number."""
    grams = []
    for t in texts:
        c = np.frombuffer(f"  {t} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        grams.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    return np.repeat(np.arange(len(grams)), [len(g) for g in grams]), np.concatenate(grams)


def _count_shared(k: int, wide: int = 4096):
    def run(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        none = {"query_id": queries["query_id"][:0], "item_id": items["item_id"][:0], "similarity": np.zeros(0)}
        if queries.empty or items.empty:
            return pd.DataFrame(none)
        sides = []
        for ids, texts in ((queries["query_id"], queries["text"]), (items["item_id"], items["text"])):
            at = np.argsort(ids.to_numpy(), kind="stable")
            names, first = np.unique(ids.to_numpy()[at], return_index=True)
            row, gram = _code_grams(texts.iloc[at])
            sides.append((names, first, len(at), row, gram))
        (q, first_q, n_q, row_q, gram_q), (c, first_c, n_c, row_c, gram_c) = sides
        known = np.intersect1d(gram_q, gram_c)
        both = np.zeros((n_q, n_c), np.float32)  # counts are exact below 2**24
        for lo in range(0, len(known), wide):
            part = known[lo : lo + wide]
            has = []
            for row, gram, n in ((row_q, gram_q, n_q), (row_c, gram_c, n_c)):
                col = np.minimum(np.searchsorted(part, gram), len(part) - 1)
                here = part[col] == gram
                m = np.zeros((n, len(part)), np.float32)
                m[row[here], col[here]] = 1
                has.append(m)
            both += has[0] @ has[1].T
        met = both > 0
        whole = lambda m, how: how.reduceat(how.reduceat(m, first_q, axis=0), first_c, axis=1)  # noqa: E731  (texts of one id count together)
        shared, size_q, size_c = whole(both.astype(np.float64), np.add), whole(met * np.bincount(row_q)[:, None], np.maximum), whole(met * np.bincount(row_c), np.maximum)
        with np.errstate(divide="ignore", invalid="ignore"):
            similarity = np.where(shared > 0, np.floor(shared / (size_q + size_c - shared) * 1e6 + 0.5) / 1e6, -np.inf)
        best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]  # ids are sorted, so ties stay in their order
        top = np.take_along_axis(similarity, best, 1)
        i, j = np.nonzero(top > -np.inf)
        return pd.DataFrame({"query_id": q[i], "item_id": c[best[i, j]], "similarity": top[i, j]})

    return run


def similar_texts(queries: DataFrame, candidates: DataFrame, k: int = 20, least: float = 0.0, block: int = 1024) -> DataFrame:
    """The k most similar candidates of each query by trigram Jaccard (to six places; ties by item_id), exactly.

    queries: query_id, text; candidates: item_id, text.  With ``least`` above 0 only pairs of ``text_pairs`` are counted.  Without a floor nearly all pairs share
    a trigram, so none can be left out: texts meet in blocks of about ``block`` a side, a block counts what its texts share as a product of two
    matrices and hands on k candidates of each query.
    """
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    if least > 0:
        texts = queries.select(F.lit(0).alias("side"), "text").union(candidates.select(F.lit(1), "text"))
        counts = stored(texts.select(F.explode(X.trigrams("text")).alias("g")).groupBy("g").agg(F.count("*").alias("n")), "grams")
        q = stored(_rarest_first(queries, "query_id", counts), "queries")
        c = stored(_rarest_first(candidates, "item_id", counts), "candidates")
        left, right = q.select("query_id", F.col("grams").alias("gq"), F.col("size").alias("size_q")), c.select("item_id", F.col("grams").alias("gc"), F.col("size").alias("size_c"))
        both = F.size(F.array_intersect("gq", "gc"))
        s = text_pairs(q, c, least).join(left, "query_id").join(right, "item_id").select("query_id", "item_id", round_half_up(both / (F.col("size_q") + F.col("size_c") - both), 6).alias("similarity"))
        return s.where(F.col("similarity") >= least).withColumn("nth", nth).where(F.col("nth") <= k)
    q, c = (df.select(key, F.lower("text").alias("text")).where("text is not null") for df, key in ((queries, "query_id"), (candidates, "item_id")))
    nq, nc = (-(-max(1, df.count()) // block) for df in (queries, candidates))
    q = q.withColumn("bq", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("bc", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = c.withColumn("bc", F.pmod(F.xxhash64("item_id"), F.lit(nc)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    out = S.StructType([S.StructField(key, df.schema[key].dataType) for df, key in ((q, "query_id"), (c, "item_id"))] + [S.StructField("similarity", S.DoubleType())])
    s = q.groupBy("bq", "bc").cogroup(c.groupBy("bq", "bc")).applyInPandas(_count_shared(k), out)
    return s.withColumn("nth", nth).where(F.col("nth") <= k)


def _block_pairs(threshold: float):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})
        unit = lambda p: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.stack(p["v"].to_numpy()))
        c = unit(queries) @ unit(rows).T
        q, r = np.nonzero(c >= threshold)
        out = pd.DataFrame({"query_id": queries["query_id"].to_numpy()[q], "vec_id": rows["vec_id"].to_numpy()[r], "cosine": c[q, r]})
        return out[out.query_id != out.vec_id]

    return run


def similar_vectors(queries: DataFrame, vectors: DataFrame, threshold: float = 0.92, block: int = 4096) -> DataFrame:
    """A stated set of queries against all vectors: pairs at or above a cosine, in blocks of about ``block`` rows a side.

    Vectors that are null, zero or hold null or non-finite components match nothing, and so do vectors of different lengths.
    """
    def fine(df: DataFrame, key: str) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col("vec_id").alias(key), v.alias("v")).where(ok).withColumn("dim", F.size("v"))

    q, x = fine(queries, "query_id"), fine(vectors, "vec_id")
    nq, nx = (-(-max(1, df.count()) // block) for df in (queries, vectors))
    q = q.withColumn("bq", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    x = x.withColumn("bx", F.pmod(F.xxhash64("vec_id"), F.lit(nx)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    out = q.groupBy("dim", "bq", "bx").cogroup(x.groupBy("dim", "bq", "bx")).applyInPandas(_block_pairs(threshold), "query_id long, vec_id long, cosine double")
    return out.select("query_id", "vec_id", round_half_up("cosine", 6).alias("cosine"))


def _common_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every place of a (rows) and b (columns): the length of the common run of characters that ends there."""
    n, m = len(a), len(b)
    rows = -(-n * (m + 1) // (m + 2))
    flat = np.zeros(rows * (m + 2), bool)
    flat[: n * (m + 1)].reshape(n, m + 1)[:, :m] = a[:, None] == b
    same = flat.reshape(rows, m + 2)  # in rows of this width diagonals are columns, kept apart by the empty column
    so_far = np.cumsum(same, axis=0, dtype=np.int16 if n < 1 << 15 else np.int32)
    so_far -= np.maximum.accumulate(np.where(same, so_far.dtype.type(0), so_far), axis=0)
    return so_far.reshape(-1)[: n * (m + 1)].reshape(n, m + 1)[:, :m]


def _common_at_most(a: str, b: str) -> int:
    """The length of the longest common subsequence, which common runs in order cannot exceed: a row of the table is one integer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        if p := places.get(c):
            p &= row
            row = (row + p | row - p) & every
    return len(a) - row.bit_count()


def match_ratio(first: str, second: str, least: float = 0.0, cells: int = 1 << 24) -> float | None:
    """``SequenceMatcher(None, first, second, autojunk=False).ratio()``; None where it is below ``least``.

    The longest common run (the first in ``first``, then in ``second``) parts both texts, and so on to both sides.  The lengths of
    all common runs are worked out once; it ends as soon as what is left cannot reach ``least``.  Texts of more than ``cells`` pairs of places are left to difflib.
    """
    total = len(first) + len(second)
    if not total:
        return 1.0 if least <= 1.0 else None
    if len(first) * len(second) > cells:
        r = SequenceMatcher(None, first, second, autojunk=False).ratio()
        return r if r >= least else None
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (first, second))
    matched, left, parts = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    if not left or 2.0 * left / total < least or least > 0 and 2.0 * _common_at_most(first, second) / total < least:
        return 0.0 if least <= 0 else None
    runs = _common_runs(a, b)
    while parts:
        i0, i1, j0, j1 = parts.pop()
        left -= min(i1 - i0, j1 - j0)
        part = np.minimum(runs[i0:i1, j0:j1], np.minimum(np.arange(1, i1 - i0 + 1)[:, None], np.arange(1, j1 - j0 + 1)))
        at = int(part.argmax())
        i, j = at // (j1 - j0), at % (j1 - j0)
        k = int(part[i, j])
        if k:
            i, j = i0 + i + 1, j0 + j + 1  # where the run ends
            matched += k
            for x in ((i0, i - k, j0, j - k), (i, i1, j, j1)):
                if x[0] < x[1] and x[2] < x[3]:
                    parts.append(x)
                    left += min(x[1] - x[0], x[3] - x[2])
        if 2.0 * (matched + left) / total < least:
            return None
    return 2.0 * matched / total


def _greedy(least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides: tuple[list, list] = ([], [])
        for item, text, side in zip(pdf["item"], pdf["text"], pdf["side"], strict=True):
            sides[side].append((item, text))
        pairs = [(-r, a, b) for a, x in sides[0] for b, y in sides[1] if (r := match_ratio(y, x, least)) is not None]
        used_a, used_b, out = set(), set(), []
        for r, a, b in sorted(pairs):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                out.append((key[0], a, b, round(-r, 6)))
        return pd.DataFrame(out, columns=["doc", "left_item", "right_item", "ratio"])

    return run


def match_greedily(left: DataFrame, right: DataFrame, least: float = 0.62) -> DataFrame:
    """Within each doc, left items to right ones by falling sequence-match ratio, each used once.

    Both: doc (long), item (long), text.  A document's items are few (the questions of a
    paper), so a group holds one document.  Documents are dealt to a fixed number of tasks: their texts are small, their comparisons are not.
    """
    both = left.select("doc", "item", "text", F.lit(0).alias("side")).unionByName(right.select("doc", "item", "text", F.lit(1).alias("side")))
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.where("text is not null").repartition(tasks, "doc").groupBy("doc").applyInPandas(_greedy(least), "doc long, left_item long, right_item long, ratio double")


def contained(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Points to the boxes they lie in, borders included; of several boxes the smallest, then the least id.

    points: keys, point_id, x, y; boxes: keys, box_id, x0, y0, x1, y1.  Places and boxes of one page are compared once, however many points and boxes
    have them: a box of a kind is its least id and a count, and what a place lies in goes back to its points.
    """
    corners = ["x0", "y0", "x1", "y1"]
    kinds = boxes.groupBy(*keys, *corners).agg(F.min("box_id").alias("box_id"), F.count("*").alias("n"))
    j = points.select(*keys, "x", "y").distinct().join(kinds, keys).where("x between x0 and x1 and y between y0 and y1")
    area, first = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.struct("area", "box_id")
    found = j.select("*", area).groupBy(*keys, "x", "y").agg(F.min(first).alias("best"), F.sum("n").alias("boxes"))
    g = points.join(found, [*keys, "x", "y"]).groupBy(*keys, "point_id").agg(F.min("best").alias("best"), F.sum("boxes").alias("boxes"))
    return g.select(*keys, "point_id", "best.box_id", "boxes")


def section_totals(items: DataFrame, section: str, score: str, printed: str, tolerance: float = 0.01) -> DataFrame:
    """Sections whose scores do not add up to the printed total."""
    g = items.groupBy(section).agg(round_half_up(F.sum(score), 4).alias("total"), F.max(printed).alias("printed"))
    return g.where(F.abs(F.col("total") - F.col("printed")) > tolerance)
