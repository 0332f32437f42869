"""URL verdicts: explicit rules first, then trust and distrust spread over the host graph.

Hosts that rules allow are seeds of trust, hosts that rules block are seeds of
distrust.  Trust follows links from its seeds (personalised PageRank); distrust
follows links backwards, from blocked hosts to those that link to them.  A host
with no fitting rule is blocked where distrust outweighs trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Verdict, host, path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING, ROUNDS, CUT = 0.85, 12, 0.5
#: Ranks are settled once four rounds change them by less than this in sum and reach no further host (the SQL runs ``ROUNDS`` rounds).
TOLERANCE = 1e-9
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?(?:https?:)?//([^/?#"'>\s]+)"""


def _parts(url: Column) -> tuple[Column, Column]:
    """(host, path): see ``judge``; no ``://`` or a null url gives two empty strings."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(authority, _UP, _LOW), path


def _rule(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits (host or a subdomain, and the start of the path), as {size, rule, verdict}."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path)),
            F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in rules
    ]
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed within partitions first."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UP, _LOW).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(s: Scratch, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, r): personalised rank of each kind over its own edges.

    edges: kind, src, dst, n; seeds: kind, host.  One round sends each host's rank along
    its edges in proportion to n; what a host without edges holds goes back to the seeds.
    As it goes back in the seeds' own proportions it only scales the ranks, so rounds leave it out and
    the settled ranks are scaled to a sum of 1 a kind.  Rounds go on until the ranks are settled and every host that links lead to has one.
    """
    seeds = s.save(seeds.distinct(), "seeds")
    count = seeds.groupBy("kind").agg(F.count("*").alias("seeds"))
    start = s.save(seeds.join(count, "kind").select("kind", "host", (1 / F.col("seeds")).alias("seed")), "start")
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    share = s.save(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")), "shares")
    rank = start.select("kind", "host", F.col("seed").alias("r"))
    if not edges.limit(1).count():
        return rank
    settled = start.select("kind", "host", F.col("seed").alias("r"))
    while True:
        for _ in range(4):
            sent = share.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("w") * F.col("r"))).alias("r"))
            rank = sent.union(start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        rank = s.save(rank, "rank")
        both = rank.join(settled.withColumnRenamed("r", "was"), ["kind", "host"], "left")
        change = both.agg(F.sum(F.abs(F.col("r") - F.coalesce("was", F.lit(0.0)))).alias("sum"), F.count(F.when(F.col("was").isNull(), 1)).alias("new")).first()
        if not change["new"] and (change["sum"] or 0.0) < tolerance:
            break
        settled = rank
    whole = rank.groupBy("kind").agg(F.sum("r").alias("whole"))  # two rows
    return s.save(rank.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("r") / F.col("whole")).alias("r")), "ranks")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A row per input row: page_id, host, path, rule (null if none fits) and verdict (allow or block).

    pages: page_id (long), url and html; other columns are not read.  The host is what
    stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; the path goes on to ``?``, ``#`` or the end.  A null url, or one without
    ``://``, has an empty host and path, no rule and no links, and is allowed; a null html
    has no links; repeated rows each get their row (their links count each); an
    empty table gives an empty result.
    """
    s = Scratch(pages.sparkSession, "urls")
    host, path = _parts(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html").withColumn("hit", _rule(rules))
    edges = s.save(host_edges(p), "edges")
    seeds = p.where("host <> '' and hit is not null").select(F.expr("if(hit.verdict = 'allow', 'trust', 'distrust')").alias("kind"), "host")
    out = p.select("page_id", "host", "path", "hit")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    rank = spread(s, both, seeds)
    sums = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("r"))).alias("t"), F.sum(F.when(F.col("kind") == "distrust", F.col("r"))).alias("d"))
    t, d = F.coalesce("t", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    bad = s.save(sums.where(d > CUT * (t + d)).select(F.col("host").alias("bad_host")), "blocked")
    out = out.join(bad, out.host == bad.bad_host, "left")
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fit = lambda what: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in ordered)
    steps, last = [], "rank0"
    for i in range(1, ROUNDS + 1):
        steps.append(
            f"rank{i} AS (SELECT kind, host, sum(r) AS r FROM (SELECT s.kind, s.dst AS host, {DAMPING} * s.w * k.r AS r FROM share s JOIN {last} k ON k.kind = s.kind AND k.host = s.src "
            f"UNION ALL SELECT kind, host, {1 - DAMPING} * r FROM rank0) GROUP BY kind, host)"
        )
        last = f"rank{i}"
    link = _LINK.replace("'", "''")
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {fit(lambda v, h, p: h + p)} END AS rule, CASE {fit(lambda v, h, p: v)} END AS given FROM parsed),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{_UP}', '{_LOW}') AS dst FROM parsed),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
sides AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
share AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM sides),
seeds AS (SELECT DISTINCT CASE given WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host FROM ruled WHERE given IS NOT NULL AND host <> ''),
rank0 AS (SELECT kind, host, 1.0 / count(*) OVER (PARTITION BY kind) AS r FROM seeds),
{", ".join(steps)},
bad AS (SELECT host FROM (SELECT host, coalesce(sum(CASE kind WHEN 'trust' THEN r END), 0) AS t, coalesce(sum(CASE kind WHEN 'distrust' THEN r END), 0) AS d FROM (SELECT kind, host, r / sum(r) OVER (PARTITION BY kind) AS r FROM {last}) GROUP BY host) WHERE d > {CUT} * (t + d))
SELECT page_id, r.host, path, rule, coalesce(given, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r LEFT JOIN bad b ON b.host = r.host
"""


ORACLE = _oracle()
