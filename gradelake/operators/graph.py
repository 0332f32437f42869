"""Prerequisite graphs: closure, strong components, levels and connected components over edge tables.

Every round is written before the next one reads it, and tables that no later round reads are deleted.  Levels and
strong components work on the edges that are left, never on a closure.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import forget, stored


def _doubled(paths: DataFrame, best) -> DataFrame:
    """(src, dst, hops): all paths of ``paths`` joined end to end until no pair of ends is new or better."""
    known, before = stored(paths), None
    while True:
        now = tuple(known.agg(F.count("*"), F.sum("hops")).first())
        if now == before:
            return known
        before = now
        a, b = known.select("src", F.col("dst").alias("mid"), F.col("hops").alias("h1")), known.select(F.col("src").alias("mid"), "dst", F.col("hops").alias("h2"))
        longer = a.join(b, "mid").select("src", "dst", (F.col("h1") + F.col("h2")).alias("hops"))
        known = stored(known.unionByName(longer).groupBy("src", "dst").agg(best("hops").alias("hops")))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, hops): everything reachable, with the least number of edges."""
    return _doubled(edges.select("src", "dst").distinct().withColumn("hops", F.lit(1)), F.min)


def _peeled(edges: DataFrame) -> DataFrame:
    """(node, level) of the nodes in ``edges`` that reach no cycle: the longest way down.

    Each round settles the nodes whose edges all lead to settled ones, and every other edge that leads to a node with one edge left jumps
    over it: such a node's level is max(c, w + level of what it leads to), and two of these make a third.  So a chain's
    length is halved a round, and a round that settles nobody ends it: what is left reaches a cycle.  Rounds are at most the depth, and
    each reads only the edges that are left.  In the table of a round dst is null where w is a level known from settled nodes.
    """
    by_src = Window.partitionBy("src")
    open_, c = F.count("dst").over(by_src).alias("open"), F.max(F.when(F.col("dst").isNull(), F.col("w"))).over(by_src).alias("c")
    e = stored(edges.where("src is not null and dst is not null").select("src", "dst", F.lit(1).cast("long").alias("w")).distinct().select("*", open_, c))
    ends = e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    settled, longest, out = stored(ends.select("node", F.lit(0).cast("long").alias("level"))), e.count(), []
    none = F.lit(None).cast(e.schema["dst"].dataType)
    while not settled.isEmpty():
        out.append(settled)
        at = settled.select(F.col("node").alias("on"), F.col("level").alias("below"))
        single = e.where("open = 1 and dst is not null").where(F.col("w") <= longest).select(F.col("src").alias("dst"), F.col("dst").alias("on"), F.col("w").alias("further"), "c")
        single = single.join(at, "on", "left").select("dst", F.when(F.col("below").isNull(), F.col("on")).alias("on"), "further", "c", F.greatest("c", F.col("further") + F.col("below")).alias("known"), F.col("below").isNotNull().alias("ends"))
        ahead = settled.select(F.col("node").alias("dst"), none.alias("on"), F.lit(None).cast("long").alias("further"), F.lit(None).cast("long").alias("c"), F.col("level").alias("known"), F.lit(True).alias("ends")).unionByName(single)
        j = e.where("open > 0").select("src", "dst", "w").join(ahead, "dst", "left")
        step = lambda dst, w: F.struct(dst.alias("dst"), w.alias("w"))
        stays = F.col("dst").isNull() | F.col("ends").isNull() | (F.col("w") > longest)
        new = F.when(F.col("ends"), F.array(step(none, F.col("w") + F.col("known")))).when(stays, F.array(step(F.col("dst"), F.col("w"))))
        new = new.otherwise(F.array(step(F.col("on"), F.col("w") + F.col("further")), step(none, F.col("w") + F.coalesce("c", F.lit(1)))))
        moved = j.select("src", F.explode(new).alias("t")).groupBy("src", "t.dst").agg(F.max("t.w").alias("w"))
        moved = stored(moved.select("*", open_, c))
        forget(e)
        e = moved
        settled = stored(e.where("open = 0").select(F.col("src").alias("node"), F.col("c").alias("level")))
    forget(e, settled)
    return functools.reduce(DataFrame.unionAll, out) if out else ends.select("node", F.lit(0).cast("long").alias("level")).limit(0)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the longest chain of prerequisites below a node (``src`` needs ``dst``); nodes on or above a cycle have none (null)."""
    bound = _peeled(edges)
    out = nodes.select("node").distinct().join(bound, "node", "left")
    above = edges.select(F.col("src").alias("node"), F.lit(True).alias("above")).distinct()
    return out.join(above, "node", "left").select("node", F.coalesce("level", F.when(F.col("above").isNull(), F.lit(0))).cast("int").alias("level"))


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): each node's least label among its own (or null) and those of the nodes with a way to it; only changed labels go on, a step a round."""
    label = stored(start)
    front = label
    while not front.isEmpty():
        sent = edges.join(front.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        lower = F.coalesce(F.col("new") < F.col("label"), F.col("new").isNotNull())
        now = stored(label.join(sent, "node", "left").select("node", F.when(lower, F.col("new")).otherwise(F.col("label")).alias("label"), lower.alias("changed")))
        forget(label)
        label, front = now, now.where("changed")
    return label


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, node): the strong components with a cycle, named by their least node.

    Nodes that reach no cycle, or that none reaches, are peeled off first.  Of the rest each node takes the least node with a way to it; a
    node that keeps its own name and the nodes of its name with a way back to it are a component.  These go,
    and the rest is peeled and named again.
    """
    e = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    out = [e.where("src = dst").select(F.col("src").alias("cycle"), F.col("src").alias("node"))]
    rest = stored(e.where("src <> dst"))
    while not rest.isEmpty():
        for _ in range(2):  # what reaches no cycle, then, edges turned, what none reaches
            off = _peeled(rest).select("node")
            kept = stored(rest.join(off.withColumnRenamed("node", "src"), "src", "left_anti").join(off.withColumnRenamed("node", "dst"), "dst", "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            forget(rest)
            rest = kept
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        name = _spread(nodes.select("node", F.col("node").alias("label")), rest)
        a, b = name.select(F.col("node").alias("src"), F.col("label").alias("la")), name.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
        same = stored(rest.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst"))
        back = _spread(name.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label")), same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = stored(back.where("label is not null").select(F.col("label").alias("cycle"), "node"))
        real = found.join(found.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1"), "cycle").select("cycle", "node")
        out.append(real)
        left = stored(same.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
        forget(rest, same, name, back)
        rest = left
    return functools.reduce(DataFrame.unionAll, out).groupBy("node").agg(F.min("cycle").alias("cycle")).select("cycle", "node")


def _first(i: int, c: str) -> Column:
    """A node's place in the order of round i: by name in even rounds (stars settle at once), by a hash in odd ones (chains shrink)."""
    return F.struct((F.xxhash64(F.lit(i), F.col(c)) if i % 2 else F.lit(0)).alias("h"), F.col(c).alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable.

    Each round every node points to the one of its neighbours and itself that comes first in an order of that
    round's own, what is pointed to is followed once more, and edges are redrawn between the ends;
    an edge is gone when both of its ends meet, so each round leaves a share of the edges.
    Tables of nodes meet by sorting: in Parquet they look small enough to broadcast, but they grow with the graph.
    """
    e = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    e, steps = stored(e.where("src <> dst")), []
    while not e.isEmpty():
        i = len(steps)
        near = e.union(e.select("dst", "src")).groupBy(F.col("src").alias("v")).agg(F.min(_first(i, "dst")).alias("low"))
        near = stored(near.select("v", F.least("low", _first(i, "v"))["p"].alias("p")))
        to = stored(near.join(near.select(F.col("v").alias("p"), F.col("p").alias("q")).hint("merge"), "p").select("v", F.col("q").alias("p")))
        steps.append(to)
        a, b = to.select(F.col("v").alias("src"), F.col("p").alias("a")), to.select(F.col("v").alias("dst"), F.col("p").alias("b"))
        e = stored(e.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    label = nodes.select("node", F.col("node").alias("at"))
    for to in steps:
        label = stored(label.join(to.select(F.col("v").alias("at"), "p").hint("merge"), "at", "left").select("node", F.coalesce("p", "at").alias("at")))
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(least.hint("merge"), "at").select("node", "component")
