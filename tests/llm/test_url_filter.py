import numpy as np
from gradelake.llm.common import Scratch
from gradelake.llm import url_filter as U


def test_parts_and_rules(spark):
    urls = [
        ("HTTP://Blog.Example.ORG/en/1?x#y", "blog.example.org", "/en/1", "example.org/en/1", "block"),
        ("https://a.org", "a.org", "", None, "allow"),
        ("https://a.org?q=/x", "a.org", "", None, "allow"),
        ("https://org/", "org", "/", "org/", "allow"),
        ("x://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("x://www.example.org/es/1://b", "www.example.org", "/es/1://b", "example.org/es/", "block"),
        ("https://s.com/fr/a", "s.com", "/fr/a", "com/fr/", "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://\nx.org/a\nb?c", "\nx.org", "/a\nb", "org/", "allow"),
        ("https://z.net/a", "z.net", "/a", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in U.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), urls[i]
        assert rule is None or got[i].verdict == verdict
    assert U.judge(df.limit(0)).count() == 0


def test_distrust_flows_back_along_links(spark):
    bad, good = "http://s.com/de/1", "http://t.org/a"
    link = lambda *hosts: "".join(f'<p><a class=x HREF="https://{h}/q">q</a>' for h in hosts)
    rows = [(1, bad, ""), (2, good, link("friend.net")), (3, "http://farm.net/", link("s.com", "S.com")), (4, "http://friend.net/", link("other.net")), (5, "http://other.net/", ""), (6, "http://far.net/", link("farm.net")), (7, "http://alone.net/", None)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [(0, "http://s.com/de/1", "")] + [(i, f"http://h{i}.net/", f'<a href="http://{"s.com" if i == 1 else f"h{i - 1}.net"}/">x</a>') for i in range(1, 19)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(19)}


def test_ranks_against_a_dense_solution(spark):
    r = np.random.default_rng(6)
    n, kinds = 40, ("trust", "distrust")
    edges = {(k, int(a), int(b)): int(w) for k in kinds for a, b, w in zip(r.integers(0, n, 70), r.integers(0, n, 70), r.integers(1, 5, 70), strict=True) if a != b and a % 5}
    seeds = {k: sorted(set(r.integers(0, n, 4).tolist())) for k in kinds}
    got = U.spread(
        Scratch(spark, "t"), spark.createDataFrame([(k, str(a), str(b), w) for (k, a, b), w in edges.items()], "kind string, src string, dst string, n long"),
        spark.createDataFrame([(k, str(h)) for k in kinds for h in [*seeds[k], seeds[k][0]]], "kind string, host string"),
    )
    rank = {(x.kind, int(x.host)): x.r for x in got.collect()}
    for k in kinds:
        s = np.zeros(n)
        s[seeds[k]] = 1 / len(seeds[k])
        m = np.zeros((n, n))
        for (kind, a, b), w in edges.items():
            if kind == k:
                m[b, a] += w
        total = m.sum(0)
        m = np.where(total > 0, m / np.maximum(total, 1), s[:, None])  # hosts without edges send all to the seeds
        want = np.linalg.solve(np.eye(n) - U.DAMPING * m, (1 - U.DAMPING) * s)
        assert np.abs(np.array([rank.get((k, i), 0.0) for i in range(n)]) - want).max() < 1e-7
