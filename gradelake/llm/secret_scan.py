"""Secrets in texts, with multipart credentials linked within scopes (DataFrame functions only).

Base candidates (an assignment to a secret-like name, an access key id, a long
hexadecimal run) stand for themselves.  Weak candidates (a user or client name, a
short or oddly named secret, an endpoint) mean little alone.  A *scope* is a stretch of a
document in which each part (identifier, secret or endpoint) begins at most
``reach`` characters after the furthest end of those before it, with no blank line between;
a bare hexadecimal run is no part of a credential.  Weak parts are reported where their scope holds
an identifier and a secret, so the parts of a credential stand or fall together.

Joining the parts with their scopes is a sorted sweep over intervals: running sums of blank lines and of gaps
number the scopes, and a grouped maximum tells what each holds.  No pairs are made; a document's parts
are one window partition, whose frames only grow, so it costs a sort however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, doc_key, table

#: kind, role, strong, pattern, group that must be long enough, its least length.  Base kinds come first, in the order of their rank.
KINDS = [
    ("assign", "secret", True, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "identifier", True, r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "", True, r"[0-9a-f]{24,}", 0, 24),
    ("user", "identifier", False, r"""(?i)\b(user_?name|user|login|account_?id|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    ("phrase", "secret", False, r"""(?i)\b(pass_?phrase|pass_?code|pwd|credential|private_?key|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 4),
    ("endpoint", "endpoint", False, r"""(?i)\b(https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://([^\s/?#"'<>]+)""", 2, 3),
]
#: A blank line ends a scope.
BREAK = r"\n[ \t\r]*\n"
#: The same kinds without a least length in the pattern.  A match takes its whole run, so a run that is too short fails either way.
PLAIN = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
REACH = 200
MASK = "[redacted]"


def _hits(rank: int) -> Column:
    """The matches of one kind as {rank, i, gap, size, ok}: ``gap`` characters stand before each since the match before."""
    _, _, _, pattern, _, least = KINDS[rank] if rank < len(KINDS) else ("", "", False, BREAK, 0, 0)
    text = F.col("text")
    found, tested = f"m{rank}", f"g{rank}" if rank < len(KINDS) else f"m{rank}"
    gaps = F.split(text, pattern, -1)
    return F.when(
        F.size(found) > 0,
        F.transform(
            F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.col(found).alias("hit"), F.col(tested).alias("test")),
            lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"), (F.length(x["test"]) >= least).alias("ok")),
        ),
    ).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:bigint,size:bigint,ok:boolean>>"))


def credential_spans(docs: DataFrame, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the keyed rows of ``docs`` without text, and a row per key with its sorted spans (``reach``: see above).

    spans: kd, kt, list<struct<start, rank, end, kind>>; positions are code points, end exclusive.
    """
    s = Scratch(docs.sparkSession, "secrets")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *doc_key())
    for r, (_, _, _, pattern, group, _) in enumerate(KINDS):
        d = d.withColumn(f"m{r}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        d = d.withColumn(f"g{r}", F.when(F.size(f"m{r}") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) if group else F.col(f"m{r}"))
    weak = sum((F.size(f"m{r}") for r, k in enumerate(KINDS) if not k[2]), F.lit(0)) > 0
    d = d.withColumn(f"m{len(KINDS)}", F.when(weak, F.regexp_extract_all("text", F.lit(BREAK), F.lit(0))).otherwise(F.array().cast("array<string>")))
    hits = F.concat(*[_hits(r) for r in range(len(KINDS) + 1)])
    rows = s.save(d.select("doc_id", "kd", "kt", hits.alias("hits")), "hits")
    one = rows.where("size(hits) > 0").dropDuplicates(["kd", "kt"])
    each = one.select("kd", "kt", F.explode("hits").alias("h")).select("kd", "kt", "h.*")
    order = Window.partitionBy("kd", "kt", "rank").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).where("ok")
    kind, role, strong = (F.array(*[F.lit(k[j]) for k in KINDS]) for j in range(3))
    at = lambda a: F.get(a, F.col("rank"))  # noqa: E731  null for a blank line
    parts = placed.select("kd", "kt", "rank", (F.col("end") - F.col("size")).alias("start"), "end", at(kind).alias("kind"), at(role).alias("role"), at(strong).alias("strong"))
    doc = Window.partitionBy("kd", "kt").orderBy("start", "rank")
    block = F.count_if(F.col("rank") == len(KINDS)).over(doc)
    links = F.col("role") != ""
    before = F.max(F.when(links, F.col("end"))).over(Window.partitionBy("kd", "kt", "block").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("block", block).where("kind is not null").withColumn("apart", links & F.coalesce(F.col("start") > before + reach, F.lit(False)))
    parts = parts.withColumn("scope", F.count_if("apart").over(Window.partitionBy("kd", "kt", "block").orderBy("start", "rank")))
    inside = Window.partitionBy("kd", "kt", "block", "scope")
    both = F.max(F.col("role") == "identifier").over(inside) & F.max(F.col("role") == "secret").over(inside)
    kept = parts.withColumn("both", both).where("strong or both")
    spans = kept.groupBy("kd", "kt").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    return rows, s.save(spans, "spans")


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row per input row: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256 and spans.

    ``spans`` lists kind:start:end by start, then kind; base_sha256 is the digest of
    the base ones alone.  A null text counts as empty (no spans, the digest of an
    empty string); rows repeated with one id and text each get the same row;
    columns other than doc_id and text are not read; an empty table gives an empty result.
    """
    rows, spans = credential_spans(docs, reach)
    out = rows.select("doc_id", "kd", "kt").join(spans, ["kd", "kt"], "left")
    every = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    out = out.select("doc_id", every.alias("spans"))
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size(F.filter("spans", lambda x: x["rank"] > 2)).cast("long").alias("n_linked"),
        F.sha2(_join(F.filter("spans", lambda x: x["rank"] <= 2)), 256).alias("base_sha256"),
        _join(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by MASK; overlapping spans become one."""
    columns = docs.columns
    _, spans = credential_spans(docs, reach)
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["b"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["end"]).alias("b"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("a"), x["end"].alias("b"))))),
    )
    cuts = spans.select("kd", "kt", merged.alias("cuts"))
    others = [c for c in columns if c != "text"]
    d = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), "text", *doc_key()).join(cuts, ["kd", "kt"], "left")
    body = lambda i: F.substring(  # noqa: E731  what stands before cut i, or after the last
        F.col("text"),
        (F.when(i > 0, F.col("cuts")[i - 1]["b"]).otherwise(F.lit(0)) + 1).cast("int"),
        F.coalesce(F.try_element_at("cuts", i + 1)["a"] - F.when(i > 0, F.col("cuts")[i - 1]["b"]).otherwise(F.lit(0)), F.lit(2**31 - 1)).cast("int"),
    )
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size("cuts")), body), MASK))
    return d.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    scans, parts = [], []
    for r, (kind, role, strong, pattern, group, least) in enumerate([*KINDS, ("", "", False, BREAK, 0, 0)]):
        p = PLAIN.get(kind, pattern).replace("'", "''")
        scans.append(f"regexp_extract_all(text, '{p}') AS m{r}, regexp_extract_all(text, '{p}', {group}) AS g{r}, string_split_regex(text, '{p}') AS p{r}")
        parts.append(
            f"SELECT doc_id, {r} AS rank, '{kind}' AS kind, '{role}' AS role, {strong} AS strong, i, "
            f"list_sum(list_transform(p{r}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{r}[1:i-1], lambda x: length(x))), 0) AS s, "
            f"length(m{r}[i]) AS n, length(g{r}[i]) >= {least} AS ok FROM (SELECT *, unnest(range(1, len(m{r}) + 1)) AS i FROM scans)"
        )
    return f"""
WITH scans AS (SELECT doc_id, {", ".join(scans)} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
parts AS (SELECT *, CAST(s + n AS BIGINT) AS e FROM ({" UNION ALL ".join(parts)}) WHERE ok),
blocks AS (SELECT *, count(*) FILTER (kind = '') OVER (PARTITION BY doc_id ORDER BY s, rank ROWS UNBOUNDED PRECEDING) AS block FROM parts),
gaps AS (SELECT *, role <> '' AND s > max(e) FILTER (role <> '') OVER (PARTITION BY doc_id, block ORDER BY s, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {REACH} AS apart FROM blocks WHERE kind <> ''),
scoped AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY doc_id, block ORDER BY s, rank ROWS UNBOUNDED PRECEDING) AS scope FROM gaps),
whole AS (SELECT i.doc_id, i.block, i.scope FROM scoped i JOIN scoped x ON x.doc_id = i.doc_id AND x.block = i.block AND x.scope = i.scope
  WHERE i.role = 'identifier' AND x.role = 'secret' GROUP BY ALL),
kept AS (SELECT p.*, kind || ':' || CAST(s AS BIGINT) || ':' || e AS span FROM scoped p LEFT JOIN whole w ON w.doc_id = p.doc_id AND w.block = p.block AND w.scope = p.scope
  WHERE strong OR w.doc_id IS NOT NULL)
SELECT d.doc_id, count(k.s) FILTER (rank = 0) AS n_assign, count(k.s) FILTER (rank = 1) AS n_access, count(k.s) FILTER (rank = 2) AS n_hex,
  count(k.s) FILTER (rank > 2) AS n_linked,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank <= 2), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
