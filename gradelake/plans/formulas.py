"""Registered queries on formulas drawn on pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas as M
from ..sources import tables as T

#: Drawn lines by kind: glyphs (text, x0, x1, baseline, size), rules (x0, x1, y) and what they say; {a}, {b}, {c} stand for one digit each.  y is taken from the line's own.
DRAWN = [
    ([("m", 10, 20, 0, 12), ("＝", 20, 32, 0, 12), ("－", 36, 46, -7.4, 10), ("{a}", 46, 51, -7.4, 10), ("{b}", 42, 47, 7.4, 10), ("。", 56, 66, 0, 12)], [(34, 54, -3)], "m＝\\frac{-{a}}{{b}}。"),
    ([("x", 10, 16, 0, 12), ("{a}", 16.2, 20, -5.9, 7), ("{b}", 20, 24, -5.9, 7), ("+", 28, 34, 0, 12), ("y", 38, 44, 0, 12), ("{c}", 44, 48, 2, 7)], [], "x^{{a}{b}} + y_{{c}}"),
    ([("A", 10, 18, 0, 12), ("B", 18, 26, 0, 12), ("=", 30, 36, 0, 12), ("{c}", 40, 46, 0, 12)], [(10, 26, -10)], "\\overline{AB} = {c}"),
    ([("{a}", 20, 25, -8, 10), ("1", 12, 17, 5, 10), ("+", 18, 23, 5, 10), ("{b}", 26, 31, 1.5, 8), ("{c}", 26, 31, 10.5, 8)], [(10, 34, -4), (25, 32, 4)], "\\frac{{a}}{1+\\frac{{b}}{{c}}}"),
    ([("答", 10, 22, 0, 12), ("{a}", 30, 36, 0, 12), ("{b}", 36, 42, 0, 12)], [(28, 60, 3), (100, 300, -40)], "答{a}{b}"),
]


def _pages(s, d):
    """Orders as pages of three drawn lines."""
    k = F.col("o_orderkey")
    o = T.scan(s, d, "orders").select(k.alias("page"), F.posexplode(F.array(*[((k + F.col("o_custkey") * (i + 1)) % len(DRAWN)).cast("int") for i in range(3)])).alias("line", "kind"), (k % 10).alias("a"), (F.col("o_custkey") % 10).alias("b"), (k * 3 % 7).alias("c"))
    kinds = "kind int, nth int, text string, x0 double, x1 double, base double, size double"
    glyphs = [(i, n, g[0], *map(float, g[1:])) for i, (gs, _, _) in enumerate(DRAWN) for n, g in enumerate(gs)]
    rules = [(i, n, *map(float, r)) for i, (_, rs, _) in enumerate(DRAWN) for n, r in enumerate(rs)]
    said = F.col("text")
    for c in "abc":
        said = F.replace(said, F.lit("{" + c + "}"), F.col(c).cast("string"))
    down = F.col("line") * 100.0 + 50
    g = o.join(F.broadcast(s.createDataFrame(glyphs, kinds)), "kind").select("page", (F.col("line") * 100 + F.col("nth")).alias("nth"), said.alias("text"), "x0", "x1", (F.col("base") + down).alias("base"), "size", F.col("line").alias("block"))
    r = o.join(F.broadcast(s.createDataFrame(rules, "kind int, n int, x0 double, x1 double, y double")), "kind").select("page", (F.col("line") * 10 + F.col("n")).alias("rule"), "x0", "x1", (F.col("y") + down).alias("y"))
    return g, r


def rule_roles(s, d):
    return M.rule_roles(*_pages(s, d)).select("page", "rule", "role")


def formula_lines(s, d):
    return M.formula_lines(*_pages(s, d)).select("page", "line", "block", "text")


NAMES = [rule_roles, formula_lines]
QUERIES = {f.__name__: f for f in NAMES}

_O = f"WITH o AS (SELECT o_orderkey AS page, line, (o_orderkey + o_custkey * (line + 1)) % {len(DRAWN)} AS kind, o_orderkey % 10 AS a, o_custkey % 10 AS b, o_orderkey * 3 % 7 AS c FROM orders, range(3) r(line))"
_ROLES = [["frac"], [], ["overline"], ["frac", "frac"], ["underline", "none"]]
_SAID = "CASE kind " + " ".join(f"WHEN {i} THEN '{text}'" for i, (_, _, text) in enumerate(DRAWN)) + " END"
for _c in "abc":
    _SAID = f"replace({_SAID}, '{{{_c}}}', CAST({_c} AS VARCHAR))"
ORACLES = {
    "rule_roles": f"{_O} SELECT page, CAST(line * 10 + n AS INT) AS rule, role FROM o JOIN (VALUES {', '.join(f'({i}, {n}, {chr(39)}{r}{chr(39)})' for i, rs in enumerate(_ROLES) for n, r in enumerate(rs))}) v(kind, n, role) USING (kind)",
    "formula_lines": f"{_O} SELECT page, CAST(line + 1 AS INT) AS line, CAST(line AS INT) AS block, {_SAID} AS text FROM o",
}
