import hashlib
import random
import zlib

import pytest
from gradelake.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(w, least, times):
    """Runs by looking at every period and every place."""
    out = []
    for q in range(1, len(w) // times + 1):
        x = 0
        while x + q < len(w):
            s = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            n = x - s + q
            if x > s and n >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(s, s + n - r)) for r in range(1, q)):
                out.append((s, n, q))
            x += x == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def row(words):
    runs = brute(words, 6, 4)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    s, n, q = best[0] if best else (None, None, None)
    return (len(runs), s, n, q, 1000 * n // q if best else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def split(text):
    return [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if x]


def strings(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        k = r.choice([1, 2, 2, 3, 5])
        w = [r.randrange(k) for _ in range(r.randint(0, 40))]
        u = [r.randrange(k) for _ in range(r.randint(1, 4))]
        yield (u * 20)[: r.randint(0, 30)] + w + (u * 20)[: r.randint(0, 20)] if r.random() < 0.5 else w


def test_lyndon_edges_by_definition():
    for w in strings(1, 1500):
        n = len(w)
        following, agree = P.lyndon_edges(w)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if w[j:] < w[i:]), n)
            h = 0
            while j + h < n and w[i + h] == w[j + h]:
                h += 1
            assert (following[i], agree.get(i, 0)) == (j, h)


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (4, 3), (1, 2)])
def test_runs_against_every_period(limits):
    for w in strings(sum(limits), 1500):
        assert P.find_runs(w, *limits) == brute(w, *limits)


def test_linear_on_repetitive_strings():
    def fibonacci(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    def doubled(n):
        out, k = [0], 1
        while len(out) < n:
            out, k = out + out + [k], k + 1
        return out[:n]

    n, r = 40_000, random.Random(3)
    unit = [r.randrange(2) for _ in range(200)]
    strings_ = [[0] * n, [0, 1] * (n // 2), fibonacci(n), doubled(n), [bin(i).count("1") % 2 for i in range(n)], [r.randrange(2) for _ in range(n)]]
    strings_ += [[x for k in range(200) for x in [*unit, 2 + k]], [x for k in range(280) for x in [1] * k + [0]][:n], (unit * n)[:n]]
    for w in strings_:
        top = max(w)
        for x in (w, [top - c for c in w]):
            read = [0]
            P.lyndon_edges(x, read)
            assert read[0] <= 4 * len(x)


def test_named_cases():
    assert P.find_runs("a a a a a".split()) == []
    assert P.find_runs(["a"] * 6) == [(0, 6, 1)]
    assert P.find_runs(list("xabababab")) == [(1, 8, 2)]
    assert P.find_runs(list("abababa")) == []
    assert P.find_runs([]) == P.find_runs(["a"]) == []
    assert P.collapse(list("xababababy"), [(1, 8, 2)]) == list("xaby")
    assert P.collapse(list("aaaaaab"), [(0, 6, 1), (3, 4, 2)]) == ["a"]


def test_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in P.op12(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words = plant(split(d.text), d.doc_id)
        if len(words) < 800:
            assert got[d.doc_id] == row(words)
        else:
            runs = P.find_runs(words)
            assert got[d.doc_id][0] == len(runs)
    assert any(v[0] for v in got.values())


def test_edges(spark):
    long = " ".join(["to be or not"] * 30_000)
    rows = [(1, "a\x0bb\x1ca b"), (1, "a\x0bb\x1ca b"), (2, None), (3, ""), (4, " \n\t "), (None, "go go go go go go"), (5, long), (6, "la " * 6)]
    docs = spark.createDataFrame([(*r, 0, None, "x") for r in rows], "doc_id long, text string, start int, runs string, length string")
    got = P.run_digest(docs).collect()
    want = [(d, *row(split(t))) for d, t in rows if d != 5]
    assert sorted([tuple(r) for r in got if r.doc_id != 5], key=str) == sorted(want, key=str)
    five = next(r for r in got if r.doc_id == 5)
    assert (five.n_runs, five.start, five.length, five.period, five.exponent_milli) == (1, 0, 120_000, 4, 30_000_000)
    out = {r.doc_id: r for r in P.text_runs(docs).collect()}
    assert [tuple(x) for x in out[5].runs] == [(0, 120_000, 4)] and out[5].kept == "to be or not"
    assert out[2].runs == [] and out[2].kept == ""
    assert P.run_digest(docs.limit(0)).count() == P.text_runs(docs.limit(0)).count() == 0
