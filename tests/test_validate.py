from gradelake.operators import validate as V
from pyspark.sql import functions as F


def q(id, stem="", options=(), group=None, section=None, assets=(), unit="", kind="SINGLE", custom=None):
    return (id, kind, stem, [tuple(o) for o in options], group, section, list(assets), unit, custom)


def test_documents(spark):
    rows = [
        (1, [q("q1", "see ![[a:x]] $1", [("A", "one"), ("B", " ONE ")], "g1", "s1", ["x"]), q("q1", "plain", [("A", "one"), ("B", "")], "g9", "s9", ["y"], "?foo", "PUBLISHER_CUSTOM")], [("g1", "s1", ""), ("g2", "s7", "![[a:zz]]")], [("s1",)], [("x",)], [("m", "{", ["x"])]),
        (2, [q("a", "$x$ \\$ {y}", [("A", "1"), ("B", "2")])], None, None, None, None),
        (3, None, None, None, None, None),
        (4, [q("c", kind="PUBLISHER_CUSTOM", custom=("t", False)), q("d", "![[a:p]]")], None, None, [("p",), ("p",)], None),
    ]
    got = {(r["doc_id"], r["code"], r["ref"]) for r in V.validate_documents(spark.createDataFrame(rows, V.DOCUMENT)).collect()}
    want = {
        (1, "content_markup", "q1"), (1, "duplicate_options", "q1"), (1, "duplicate_id", "q1"), (1, "empty_option", "q1"), (1, "dangling_group", "q1"), (1, "dangling_section", "q1"), (1, "dangling_asset", "q1"), (1, "unit_unparsed", "q1"),
        (1, "custom_type_missing", "q1"), (1, "orphan_group", "g2"), (1, "dangling_section", "g2"), (1, "dangling_asset", "g2"), (1, "content_markup", "m"), (4, "custom_type_unconfirmed", "c"), (4, "asset_not_listed", "d"), (4, "duplicate_id", "p"),
    }
    assert got == want


def test_rubrics_picks_and_confidence(spark):
    rows = [("ok", 0, 3, 10), ("ok", 4, 10, 10), ("gap", 0, 3, 10), ("gap", 5, 10, 10), ("bad", 1, 4, 10), ("bad", 4, 8, 10)]
    got = {(r["r"], r["code"]) for r in V.rubric_gaps(spark.createDataFrame(rows, "r string, low int, high int, most int"), "r", "most").collect()}
    assert got == {("gap", "GAP"), ("bad", "OVERLAP"), ("bad", "START"), ("bad", "END")}
    picks = spark.createDataFrame([([("a", 0.5), ("b", 0.51)],), ([("a", 0.5), ("a", 0.5)],), ([("a", 0.25)] * 4,), ([("a", 0.9)],)], "p array<struct<kp:string,weight:double>>")
    assert [r[0] for r in picks.select(V.picks_fault(F.col("p"))).collect()] == [None, "REPEATED", "TOO_MANY", "WEIGHTS"]
    c = lambda a, b: V.adjusted_confidence(F.lit(a), F.lit(b).cast("double"))
    r = spark.range(1).select(c(0.95, 1.0), c(0.5, 0.6), c(0.5, 0.2), c(0.5, None)).first()
    assert tuple(r) == (1.0, 0.4, 0.3, 0.5)
