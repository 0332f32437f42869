import hashlib
import random
from collections import Counter

from gradelake.llm import suffix_dedup as S


def brute(rows, w):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(r.randint(20, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(50, 400)], text(r.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(n, "a" * 900), (n + 1, "a" * 450), (n + 2, "ab" * 300), (n + 3, None), (n + 4, ""), (n + 4, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]
    return rows


def test_against_brute_force(spark):
    for seed, w in ((1, 200), (2, 60), (3, 200)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((tuple(x) for x in S.suffix_dedup(df, w).drop("removed").collect()), key=str)
        assert got == brute(rows, w)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1000)
    groups = list(S._segments(S.np.array([0, 10, 5000, 5400]), 200))
    assert groups[0] == [(0, 0, 10)] and groups[1][0] == (1, 0, 1199) and groups[-1] == [(2, 0, 400)]


def test_repeats_over_the_borders_of_pieces(spark):
    r = S.np.random.default_rng(7)
    letters = S.np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", S.np.uint8)
    draw = lambda n: letters[r.integers(0, 27, n)].tobytes()
    passages = [draw(n) for n in (200, 201, 330, 5000)]
    long, places = bytearray(draw(5 * S.CHUNK // 2)), []
    border = S.CHUNK
    for i, (at, p) in enumerate([(border - 100, 0), (border + 60_000, 3), (2 * border - 2500, 3), (1000, 2), (2 * border + 20_000, 2), (border + 100_000, 1), (len(long) - 201, 1)]):
        part = b"%c%b%d" % (65 + i, passages[p], i)  # no two have the same neighbours
        long[at - 1 : at - 1 + len(part)] = part[: len(long) - at + 1]
        places.append((at, at + len(passages[p])))
    rows = [(1, long.decode()), (2, "<" + passages[0].decode() + ">"), (3, "(" + passages[0][1:].decode() + draw(500).decode())]
    got = {x.doc_id: x for x in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x.start, x.end) for x in got[1].removed] == sorted(places)
    assert (got[2].n_removed, got[3].n_removed) == (200, 0)
    kept, at = b"", 0
    for a, b in sorted(places):
        kept, at = kept + bytes(long[at:a]), b
    assert got[1].kept_sha256 == hashlib.sha256(kept + bytes(long[at:])).hexdigest()


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kd int")
    assert S.suffix_dedup(empty).count() == 0
    df = spark.createDataFrame([(1, "x" * 500, 7), (2, None, None)], "doc_id long, text string, ranges int")
    assert {r.doc_id: r.n_removed for r in S.suffix_dedup(df).collect()} == {1: 500, 2: 0}


def test_remove_repeats_keeps_valid_text(spark):
    rows = [(i, t, "x") for i, t in corpus(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ranges string")
    out = S.remove_repeats(df)
    assert out.columns == df.columns
    texts = [r.text for r in out.collect()]
    assert len(texts) == len(rows)
    left = Counter()
    for t in texts:
        left.update({t[i : i + 200] for i in range(len(t) - 199)})
    assert not left or max(left.values()) == 1
