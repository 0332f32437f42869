"""Registered queries on documents, texts and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.numeric import round_half_up
from ..operators import documents as D
from ..sources import tables as T


def content_hash_dupes(s, d):
    return D.hash_duplicates(T.scan(s, d, "documents"))


def legibility(s, d):
    return T.scan(s, d, "documents").select("doc_id", X.legibility("text").alias("verdict"))


def html_text(s, d):
    t = X.strip_html("html")
    return T.scan(s, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("sha"))


def _lines(s, d):
    x = T.scan(s, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return x


def running_heads(s, d):
    return D.running_heads(_lines(s, d), "source", "doc_id", "line", part=0.02)


def section_split(s, d):
    x = D.sections(_lines(s, d), "doc_id", "line_no", F.length("line") < 40)
    return x.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def merge_continued(s, d):
    c = T.scan(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("again", F.col("role") == F.lag("role").over(w))
    out = D.merge_continued(c, "conv_id", "turn", F.col("again"), "text")
    return out.select("conv_id", F.col("unit").cast("long").alias("unit"), "parts", F.sha2("text", 256).alias("sha"))


def issue_dangling_refs(s, d):
    li = T.scan(s, d, "lineitem").select((F.col("l_partkey") * 2).alias("ref_part"))
    return D.dangling(li, T.scan(s, d, "part"), "ref_part", "p_partkey", "dangling_asset")


def issue_duplicate_options(s, d):
    o = T.scan(s, d, "orders").select("o_custkey", F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit("  ")).alias("content"))
    return D.duplicate_options(o, "o_custkey", "content")


def section_totals(s, d):
    j = T.scan(s, d, "lineitem").join(T.scan(s, d, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = D.section_totals(j, "o_orderkey", "l_extendedprice", "o_totalprice")
    return out.select("o_orderkey", round_half_up("total", 2).alias("total"), "printed")


def ngram_overlap(s, d):
    """Each assistant turn against the user turn before it."""
    c = T.scan(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("before", F.lag("text").over(w)).withColumn("by", F.lag("role").over(w)).where("role = 'assistant' and by = 'user'")
    return c.select("conv_id", "turn", round_half_up(X.own_share("text", "before"), 6).alias("share"))


def trigram_topk(s, d):
    """The 20 benchmark items most like each turn of a conversation."""
    q = T.scan(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return D.similar_texts(q, T.scan(s, d, "benchmark"))


def cosine_neardup(s, d):
    """Query set: every vector whose id is divisible by 50; against all vectors."""
    e = T.scan(s, d, "embeddings")
    return D.similar_vectors(e.where("vec_id % 50 = 0"), e, 0.92)


def cosine_neighbours(s, d):
    """The same query set at a threshold that these vectors do reach."""
    e = T.scan(s, d, "embeddings")
    return D.similar_vectors(e.where("vec_id % 50 = 0"), e, 0.45)


def greedy_match(s, d):
    """Answers of each conversation to its questions, by falling similarity."""
    c = T.scan(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("item"), "text", "role")
    return D.match_greedily(c.where("role = 'user'"), c.where("role = 'assistant'"), 0.3)


def spatial_join(s, d):
    """Line items as points on the page of their supplier, parts as boxes on it."""
    p = T.scan(s, d, "lineitem").groupBy((F.col("l_suppkey") % 100).alias("page"), F.col("l_orderkey").alias("point_id")).agg(F.max("l_quantity").alias("x"), (F.max("l_discount") * 500).alias("y"))
    b = T.scan(s, d, "part").select((F.col("p_partkey") % 100).alias("page"), F.col("p_partkey").alias("box_id"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 20.0).alias("x1"), (F.col("p_partkey") % 40).cast("double").alias("y0"), (F.col("p_partkey") % 40 + 10).cast("double").alias("y1"))
    return D.contained(p, b, ["page"])


NAMES = [
    content_hash_dupes, legibility, html_text, running_heads, section_split, merge_continued, issue_dangling_refs, issue_duplicate_options, section_totals, ngram_overlap, trigram_topk, cosine_neardup, cosine_neighbours, greedy_match, spatial_join,
]
QUERIES = {f.__name__: f for f in NAMES}

_Q = "'"
_KEY = "regexp_replace(regexp_replace(translate(coalesce(text, ''), '" + X.FULL.replace(_Q, "''") + "', '" + X.HALF.replace(_Q, "''") + r"'), '^\s*\(?\d{1,3}\s*[.)、]\s*', ''), '" + X._DROP.replace(_Q, "''") + "', '', 'g')"
_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def _grams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substring({x}, i, {n}))) ELSE [] END"


ORACLES = {
    "content_hash_dupes": f"WITH k AS (SELECT doc_id, sha256({_KEY}) AS hash FROM documents) SELECT doc_id, hash, min(doc_id) OVER (PARTITION BY hash) AS first_id, count(*) OVER (PARTITION BY hash) AS copies FROM k",
    "legibility": r"SELECT doc_id, CASE WHEN han < 120 THEN 'SHORT' WHEN rare > 0.05 * han THEN 'SUSPECT' ELSE 'OK' END AS verdict FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]')) AS han, len(regexp_extract_all(coalesce(text, ''), '[\x{3400}-\x{4DBF}]')) AS rare FROM documents)",
    "html_text": f"SELECT page_id, length(t) AS n_chars, sha256(t) AS sha FROM (SELECT page_id, {_STRIP} AS t FROM pages)",
    "running_heads": T.sql(
        r"""SELECT source, head, on_pages, pages FROM (SELECT source, trim(regexp_replace(line, '\d+', '#', 'g')) AS head, count(DISTINCT doc_id) AS on_pages FROM lines WHERE trim(regexp_replace(line, '\d+', '#', 'g')) <> '' GROUP BY 1, 2)
  JOIN (SELECT source, count(DISTINCT doc_id) AS pages FROM lines GROUP BY 1) USING (source) WHERE pages >= 4 AND on_pages >= greatest(2.0, pages * 0.02)""", extra=_LINES),
    "section_split": T.sql(
        "SELECT doc_id, section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT *, CAST(sum(CAST(length(line) < 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section FROM lines) GROUP BY 1, 2", extra=_LINES),
    "merge_continued": """SELECT conv_id, unit, count(*) AS parts, sha256(string_agg(text, '' ORDER BY turn)) AS sha FROM (SELECT *, CAST(sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS unit FROM (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS again FROM conversations)) GROUP BY 1, 2""",
    "issue_dangling_refs": "SELECT 'dangling_asset' AS code, CAST(l_partkey * 2 AS VARCHAR) AS ref, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey * 2) GROUP BY 2",
    "issue_duplicate_options": "SELECT o_custkey, lower(o_orderpriority) AS content, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "section_totals": "SELECT o_orderkey, floor(floor(t * 10000 + 0.5) / 10000 * 100 + 0.5) / 100 AS total, printed FROM (SELECT o_orderkey, sum(l_extendedprice) AS t, max(o_totalprice) AS printed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) WHERE abs(floor(t * 10000 + 0.5) / 10000 - printed) > 0.01",
    "ngram_overlap": f"""SELECT conv_id, turn, CASE WHEN length(text) < 8 THEN 0.0 ELSE floor(len(list_intersect(a, b)) / greatest(len(a), 1) * 1e6 + 0.5) / 1e6 END AS share FROM (SELECT *, {_grams('text', 4)} AS a, {_grams('before', 4)} AS b FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS by_role FROM conversations) WHERE role = 'assistant' AND by_role = 'user')""",
    "trigram_topk": f"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, unnest(g) AS g, len(g) AS nq FROM (SELECT *, {_grams('t', 3)} AS g FROM (SELECT *, '  ' || lower(text) || ' ' AS t FROM conversations))),
c AS (SELECT item_id, unnest(g) AS g, len(g) AS nc FROM (SELECT *, {_grams('t', 3)} AS g FROM (SELECT *, '  ' || lower(text) || ' ' AS t FROM benchmark)))
SELECT query_id, item_id, similarity, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS nth FROM (
  SELECT query_id, item_id, floor(count(*) / (max(nq) + max(nc) - count(*)) * 1e6 + 0.5) / 1e6 AS similarity FROM q JOIN c USING (g) GROUP BY 1, 2)) WHERE nth <= 20""",
    "cosine_neardup": "SELECT q.vec_id AS query_id, e.vec_id, floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) >= 0.92",
    "cosine_neighbours": "SELECT q.vec_id AS query_id, e.vec_id, floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) >= 0.45",
    "spatial_join": """WITH p AS (SELECT l_suppkey % 100 AS page, l_orderkey AS point_id, max(l_quantity) AS x, max(l_discount) * 500 AS y FROM lineitem GROUP BY 1, 2), b AS (SELECT p_partkey % 100 AS page, p_partkey AS box_id, CAST(p_size AS DOUBLE) AS x0, p_size + 20.0::DOUBLE AS x1, CAST(p_partkey % 40 AS DOUBLE) AS y0, CAST(p_partkey % 40 + 10 AS DOUBLE) AS y1 FROM part)
SELECT page, point_id, arg_min(box_id, ((x1 - x0) * (y1 - y0), box_id)) AS box_id, count(*) AS boxes FROM p JOIN b USING (page) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""",
}
